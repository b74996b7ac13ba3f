"""Profiling queries over the final table.

Generic forms that cover the reference's nine queries:

* ``share``: per value of ``col``, ``COUNT(col)`` and its percentage of all
  (optionally de-duplicated) rows. The numerator skips NULL, the denominator
  does not, so shares need not reach 100. The denominator is the sum of the
  group sizes, so the de-duplicated input is aggregated once.
* ``mean_by``: average of ``value`` over de-duplicated rows, optionally
  filtered and grouped.
* ``reports``: any number of both from one scan and one two-step aggregate.

De-duplication is a ``distinct`` (partial aggregation before its shuffle),
never a collect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillroll.functions.numeric import DEC, exact_mean, rounded_ratio_pct
from tillroll.operators.order_stats import top_k


def share(df: DataFrame, col: str, entity: list[str] | None = None,
          count_alias: str | None = None, pct_alias: str | None = None,
          scale: int = 2) -> DataFrame:
    """``col, <col>_count, <col>_percent``.

    ``entity`` de-duplicates first: ``SELECT DISTINCT entity..., col`` (the
    reference's ``DISTINCT(customer_id), gender`` is a whole-row DISTINCT).
    """
    count_alias = count_alias or f"{col}_count"
    pct_alias = pct_alias or f"{col}_percent"
    base = df.select(*entity, col).distinct() if entity else df.select(col)
    groups = base.groupBy(col).agg(F.count(F.col(col)).alias(count_alias),
                                   F.count(F.lit(1)).alias("__rows"))
    # Over the few grouped rows, so the input is aggregated once.
    total = F.sum("__rows").over(Window.partitionBy())
    return groups.select(col, count_alias,
                         rounded_ratio_pct(F.col(count_alias), total, scale).alias(pct_alias))


def ordered_share(shares: DataFrame, col: str, pct_alias: str | None = None) -> DataFrame:
    """L1: percent descending with NULLs first (PostgreSQL ``DESC``), key as tiebreak."""
    pct_alias = pct_alias or f"{col}_percent"
    return shares.orderBy(F.col(pct_alias).desc_nulls_first(), F.col(col).asc_nulls_first())


def numbered(ordered: DataFrame, alias: str = "rank") -> DataFrame:
    """The place of each row of an ordered report, as it would be printed."""
    one = ordered.coalesce(1)
    return one.withColumn(alias, F.monotonically_increasing_id() + 1)


def top_share(shares: DataFrame, col: str, k: int, pct_alias: str | None = None) -> DataFrame:
    """The ``k`` largest shares ("top 5 states", "top 10 brands")."""
    pct_alias = pct_alias or f"{col}_percent"
    return top_k(shares, pct_alias, k, tiebreak=[col])


def mean_by(df: DataFrame, value: str, by: list[str] | None, distinct_on: list[str],
            where: Column | None = None, scale: int | None = None,
            alias: str = "mean") -> DataFrame:
    """Mean of ``value`` over ``DISTINCT distinct_on`` rows.

    ``scale`` None keeps the double average (``AVG`` of a double column);
    otherwise the decimal mean is rounded once, half away from zero.
    """
    cols = list(dict.fromkeys([*distinct_on, *(by or []), value]))
    base = df.select(*cols).distinct()
    if where is not None:
        base = base.where(where)
    v = F.col(value)
    agg = F.avg(v) if scale is None else exact_mean(F.sum(v), F.count(v), scale)
    if by:
        return base.groupBy(*by).agg(agg.alias(alias))
    return base.agg(agg.alias(alias))


@dataclass(frozen=True)
class Report:
    """One report over (optionally de-duplicated) rows, per value of ``by``.

    Without ``amount`` it is a share (O3, O4, O6-O9), with it a mean (O1, O2, O5)
    over the rows that ``where`` holds for, distinct by entity, ``by`` and amount.
    ``scale`` rounds the mean once; None keeps the double average.
    """

    name: str
    by: str | None = None
    entity: str | None = None
    amount: str | None = None
    where: Column | None = None
    scale: int | None = None


def reports(df: DataFrame, wanted: list[Report]) -> DataFrame:
    """``report, value, n, percent, mean`` of all ``wanted`` reports, from one scan.

    Every row is expanded to a few rows, one for all reports of an entity (money
    differs from row to row, so reports of it have their own). These are combined
    in their task by all they hold, which de-duplicates, and only then expanded to
    a row per report, combined by (report, entity, value, amount), then by (report,
    value), so a hot value costs a row per task. Reports without an entity count
    rows. The totals are a row per report, so their broadcast is bounded by
    ``wanted``. ``n`` counts the known values (shares) or amounts (means).
    """
    money = {f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)}
    kinds: dict = {}
    for i, r in enumerate(wanted):
        own = r.amount if r.amount in money else None
        kinds.setdefault((r.entity, own) if r.entity else i, []).append(i)
    together = list(kinds.values())
    columns = {f"by_{c}": (c, "string") for c in sorted({r.by for r in wanted if r.by})}
    columns |= {f"amount_{c}": (c, DEC) for c in sorted({r.amount for r in wanted if r.amount})}

    def part(kind: int, ids: list[int]) -> Column:
        """What the reports ``ids`` read of a row."""
        of = [wanted[i] for i in ids]
        read = {f"by_{r.by}" for r in of} | {f"amount_{r.amount}" for r in of}
        entity = of[0].entity
        return F.struct(
            F.lit(kind).alias("kind"), (F.col(entity) if entity else F.lit(None)).cast("string").alias("entity"),
            *[(F.col(c) if name in read else F.lit(None)).cast(kept).alias(name) for name, (c, kept) in columns.items()],
            *[(F.coalesce(r.where, F.lit(False)) if i in ids else F.lit(None).cast("boolean")).alias(f"held_{i}")
              for i, r in enumerate(wanted) if r.where is not None])

    def chosen(make) -> Column:
        out = F.lit(None)
        for i, r in enumerate(wanted):
            out = F.when(F.col("report") == i, make(r)).otherwise(out)
        return out

    shared = F.get(F.array(*[F.lit(any(i in ids for ids in together if len(ids) > 1))
                             for i in range(len(wanted))]), F.col("report"))
    seen = df.select(F.inline(F.array(*[part(k, ids) for k, ids in enumerate(together)])))
    seen = seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("times"))
    each = seen.withColumn("report", F.explode(F.get(
        F.array(*[F.array(*[F.lit(i) for i in ids]) for ids in together]), F.col("kind"))))
    for i, r in enumerate(wanted):
        if r.where is not None:
            each = each.where((F.col("report") != i) | F.col(f"held_{i}"))
    # A report that shares its rows may meet an (entity, value, amount) again; the others do not.
    rows = each.select(
        "report", F.when(shared, F.col("entity")).alias("entity"),
        chosen(lambda r: F.col(f"by_{r.by}") if r.by else F.lit(None).cast("string")).alias("value"),
        chosen(lambda r: F.col(f"amount_{r.amount}") if r.amount else F.lit(None).cast(DEC)).alias("amount"),
        chosen(lambda r: F.lit(1).cast("long") if r.entity else F.col("times")).alias("times"))
    known = F.sum(F.when(F.col("amount").isNotNull(), F.col("times")))
    rows = rows.groupBy("report", "entity", "value", F.when(shared, F.col("amount")).alias("same")).agg(
        F.when(shared, F.lit(1)).otherwise(F.sum("times")).alias("rows"),
        F.when(shared, F.max("amount")).otherwise(F.sum(F.col("amount") * F.col("times"))).alias("total"),
        F.when(shared, F.least(known, F.lit(1))).otherwise(known).alias("amounts"))
    groups = rows.groupBy("report", "value").agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"),
        F.coalesce(F.sum("amounts"), F.lit(0)).alias("amounts"))
    # True of every group. It reads all that a group holds, so that groups and totals come
    # from the same shuffle and what is before it is not computed once more for the totals.
    group = (F.col("amounts") >= 0) & (F.coalesce(F.abs("total"), F.lit(0)) >= 0)
    totals = groups.groupBy(F.col("report").alias("of")).agg(F.sum(F.when(group, F.col("rows"))).alias("all_rows"))

    known = F.when(F.col("value").isNotNull(), F.col("rows")).otherwise(F.lit(0))
    n = F.when(chosen(lambda r: F.lit(r.amount is not None)), F.col("amounts")).otherwise(known)
    return (groups.join(F.broadcast(totals), F.col("report") == F.col("of")).select(
        chosen(lambda r: F.lit(r.name)).alias("report"), "value", n.alias("n"),
        chosen(lambda r: F.lit(None).cast("double") if r.amount
               else rounded_ratio_pct(known, F.col("all_rows"))).alias("percent"),
        chosen(lambda r: _mean_of(r)).alias("mean")))


def _mean_of(r: Report) -> Column:
    total, n = F.col("total"), F.col("amounts")
    if r.amount is None:
        return F.lit(None).cast("double")
    if r.scale is None:
        return F.when(n > 0, total.cast("double") / n)
    return exact_mean(total, n, r.scale).cast("double")
