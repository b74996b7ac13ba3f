"""Keyed means (W1-W8) and hierarchical imputation.

The reference fills a missing (NULL or 0) value with the first usable group
mean over a hierarchy of keys, then a global median::

    CASE WHEN v <> 0 AND v IS NOT NULL THEN v
         WHEN round(avg(v) OVER (PARTITION BY level1), k) is usable THEN that
         ... level2, level3 ...
         ELSE fallback END

where "usable" means neither NULL nor 0 *after rounding*. That CASE is
``coalesce(nullif(v, 0), nullif(mean1, 0), nullif(mean2, 0), ..., fallback)``.

Plan: one aggregate with a grouping set per level (``level_stats``) holds the sum,
count and rows of every group. Every level is combined by its own keys on the map
side, so a task sends at most one row per group of a level and a hot key costs
one row per task; the second step adds those up. The result, a row per group, is
stored, and the levels' means are read from it.

Only rows that miss a value look anything up; complete rows pass by in a branch
of their own that no lookup touches. A NULL key is one group, as in ``PARTITION
BY``. Groups that hold a ``1 / HEAVY_KEYS`` share of the rows are at most
``HEAVY_KEYS`` by that very condition: their means are broadcast and their rows
spread over the tasks of the shuffled lookup that serves all others. Of stored
rows only the keys are looked up, and each level moves only those that the levels
before left open (``fills``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import DEC, exact_mean
from tillroll.sources import store

HEAVY_KEYS = 1000           # a group with a larger share of the rows than 1 in so many is heavy
SPREAD = 1024               # tasks over which a heavy group's rows are spread
RUN_ROWS = 4096             # row numbers whose fills lie in one stored row

# Flag and level labels (fixed values of the reference's output).
YES, NO = "yes", "no"
OWN, FALLBACK = "own", "median"


def missing(col: str) -> Column:
    """0 and NULL both count as missing (negatives are present values)."""
    c = F.col(col)
    return c.isNull() | (c == 0)


def keyed_mean(df: DataFrame, value: str, keys: list[str], scale: int,
               alias: str = "mean") -> DataFrame:
    """``keys + [alias]`` with ``round(avg(value), scale)`` per key group.

    NULLs are skipped, zeros and negatives counted; an all-NULL group gives
    NULL. Rounded once, exactly (``round(sum / count)``).
    """
    v = F.col(value)
    return df.groupBy(*keys).agg(exact_mean(F.sum(v), F.count(v), scale).alias(alias))


@dataclass(frozen=True)
class Target:
    """One column to complete.

    ``fallback`` is a scalar Column (e.g. the median as a literal) used when
    no level has a usable mean; it may itself be NULL.
    """
    value: str
    scale: int
    out: str
    fallback: Column | None = None
    flag: str | None = None
    level_col: str | None = None


def level_stats(df: DataFrame, levels: list[list[str]], targets: list[Target]) -> DataFrame:
    """One aggregate for all levels: per group of every level its rows, and sum and
    count of every target; ``__set`` tells the levels apart (``_set_id``)."""
    keys = _keys(levels)
    return df.groupingSets([[F.col(k) for k in level] for level in levels], *keys).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("__rows"),
        *[F.sum(t.value).alias(f"__s_{t.value}") for t in targets],
        *[F.count(t.value).alias(f"__n_{t.value}") for t in targets])


def _keys(levels: list[list[str]]) -> list[str]:
    return list(dict.fromkeys(k for level in levels for k in level))


def _set_id(levels: list[list[str]], i: int) -> int:
    """``grouping_id`` of level i: a bit per key, set where the level lacks it."""
    out = 0
    for k in _keys(levels):
        out = 2 * out + (k not in levels[i])
    return out


def level_lookup(stats: DataFrame, levels: list[list[str]], i: int, targets: list[Target]) -> DataFrame:
    """``__k<i>_<j>, __m<i>_<target>, __rows``: level i's usable rounded means."""
    means = [F.nullif(exact_mean(f"__s_{t.value}", f"__n_{t.value}", t.scale), F.lit(0))
             .alias(f"__m{i}_{t.value}") for t in targets]
    lk = stats.where(F.col("__set") == _set_id(levels, i)).select(
        *[F.col(k).alias(f"__k{i}_{j}") for j, k in enumerate(levels[i])], *means, "__rows")
    # A key whose means are all unusable never fills anything.
    return lk.where(reduce(lambda a, b: a | b, [F.col(f"__m{i}_{t.value}").isNotNull() for t in targets]))


def _look_up(frame: DataFrame, stats: DataFrame, levels: list[list[str]], i: int,
             targets: list[Target], total: Column) -> DataFrame:
    """Level i's means at every row of ``frame``, as ``__m<i>_<target>``."""
    lk, keys = level_lookup(stats, levels, i, targets), levels[i]
    heavy_share = F.col("__rows") * HEAVY_KEYS >= total
    same_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}_{j}")) for j, k in enumerate(keys)])
    helper = [f"__k{i}_{j}" for j in range(len(keys))]
    spread = F.pmod(F.xxhash64(*frame.columns), F.lit(SPREAD)) + 1
    # At most HEAVY_KEYS rows can hold such a share each.
    heavy = lk.where(heavy_share).select(
        *helper, *[F.col(f"__m{i}_{t.value}").alias(f"__h{i}_{t.value}") for t in targets], F.lit(True).alias("__found"))
    frame = frame.withColumn("__spread", spread).join(F.broadcast(heavy), same_key, "left").drop(*helper)
    frame = frame.withColumn("__at", F.when(F.col("__found"), F.col("__spread")).otherwise(F.lit(0)))
    light = lk.where(~heavy_share).drop("__rows").withColumn("__zero", F.lit(0).cast("long"))
    frame = frame.join(light, same_key & (F.col("__at") == F.col("__zero")), "left")
    means = {f"__m{i}_{t.value}": F.coalesce(f"__h{i}_{t.value}", f"__m{i}_{t.value}") for t in targets}
    return frame.withColumns(means).drop(*helper, *[f"__h{i}_{t.value}" for t in targets],
                                         "__spread", "__found", "__at", "__zero")


def fills(todo: DataFrame, stats: DataFrame, levels: list[list[str]], targets: list[Target],
          total: Column, at: list[str]) -> DataFrame:
    """``at, __f_<target>, __l_<target>``: the first usable mean of every missing
    value of ``todo`` and the level it is from; rows without any have no row here.

    Only ``at`` and the keys of levels to come travel, and a row leaves once all
    its missing values are found.
    """
    def found(frame: DataFrame) -> DataFrame:
        return frame.select(*at, *[f"__{k}_{t.value}" for k in "fl" for t in targets])

    def names_from(i: int) -> list[str]:
        return list(dict.fromkeys([*at, *_keys(levels[i:])]))

    frame = todo.select(*names_from(0), *[c for t in targets for c in (
        missing(t.value).alias(f"__need_{t.value}"),
        F.lit(None).cast(f"decimal(18,{t.scale})").alias(f"__f_{t.value}"),
        F.lit(None).cast("int").alias(f"__l_{t.value}"))])
    own = [f"__{k}_{t.value}" for t in targets for k in ("need", "f", "l")]
    is_open = reduce(lambda a, b: a | b, [F.col(f"__need_{t.value}") & F.col(f"__f_{t.value}").isNull() for t in targets])
    out = None
    for i in range(len(levels)):
        frame = _look_up(frame, stats, levels, i, targets, total)
        new = {}
        for t in targets:
            f, m = F.col(f"__f_{t.value}"), F.col(f"__m{i}_{t.value}")
            here = F.col(f"__need_{t.value}") & f.isNull() & m.isNotNull()
            new[f"__f_{t.value}"] = F.when(here, m).otherwise(f)
            new[f"__l_{t.value}"] = F.when(here, F.lit(i)).otherwise(F.col(f"__l_{t.value}"))
        frame = frame.withColumns(new).select(*names_from(i + 1), *own)
        last = i == len(levels) - 1
        known = reduce(lambda a, b: a | b, [F.col(f"__f_{t.value}").isNotNull() for t in targets])
        done = found(frame.where(known if last else ~is_open))
        out = done if out is None else out.unionByName(done)
        frame = frame.where(is_open)
    return out


def fill_runs(filled: DataFrame, targets: list[Target], at: list[str], parts: int) -> DataFrame:
    """The fills with a row per ``at[1]`` and run of ``RUN_ROWS`` row numbers: ``at[1],
    __first, __fills`` (row number -> fills), dealt by ``at[1]``."""
    row, key = F.col(at[0]), at[1]
    fill = F.struct(*[f"__{k}_{t.value}" for t in targets for k in "fl"])
    return (filled.repartition(parts, key)
            .groupBy(key, (row - F.pmod(row, F.lit(RUN_ROWS))).alias("__first"))
            .agg(F.map_from_entries(F.collect_list(F.struct(row, fill))).alias("__fills")))


def _with_fills(todo: DataFrame, runs: DataFrame, targets: list[Target], at: list[str]) -> DataFrame:
    """``todo`` with its fills. The join's only equality is on the column that both sides
    are bucketed by, so they meet as they lie; a row is in one run at most."""
    row, cols = F.col(at[0]), todo.columns
    same = (F.col("__at") == F.col(at[1])) & (row >= F.col("__first")) & (row < F.col("__first") + RUN_ROWS)
    got = runs.withColumnRenamed(at[1], "__at").join(todo, same, "right").select(
        *cols, F.try_element_at("__fills", row).alias("__fill"))
    return got.select(*cols, *[F.col(f"__fill.__{k}_{t.value}") for t in targets for k in "fl"])


def hierarchical_impute(df: DataFrame, targets: list[Target], levels: list[list[str]],
                        level_names: list[str] | None = None,
                        stats_from: DataFrame | None = None,
                        stored: Callable[[DataFrame], DataFrame] | None = None,
                        tag: str | None = None, at: list[str] | None = None,
                        stored_fills: Callable[[Callable[[], DataFrame]], DataFrame] | None = None,
                        lies_by: str | None = None) -> DataFrame:
    """Add ``t.out`` (+ ``t.flag``, ``t.level_col``) for every target.

    ``levels`` are key lists, most specific first. Group means come from
    ``stats_from`` (default ``df``): the reference computes its windows over
    the joined rows before later joins fan them out. ``stored`` keeps the group
    sums (default: in the application's scratch folder). ``df`` is read twice,
    for complete and for incomplete rows; ``tag`` names a boolean column, true
    where a target is missing, by which a stored ``df`` is partitioned, so that
    each row is read once. It is dropped.

    By default the incomplete rows themselves go through the lookups. Where they
    are wide and stored, ``at`` names the row's number and the column that ``stats_from``
    is bucketed by: then only the keys go (``fills``), ``stored_fills`` keeps the result in
    the same buckets, and no row moves to meet it. The number is dropped.

    ``lies_by`` names the column that ``df`` is bucketed by: rows that moved for their
    lookups go back to their buckets, so the result lies as ``df`` does.
    """
    source = df if stats_from is None else stats_from
    stats = (stored or (lambda x: store.keep(x, "levels")))(level_stats(source, levels, targets))
    names = level_names or [",".join(k) for k in levels]
    any_missing = F.col(tag) if tag else reduce(lambda a, b: a | b, [missing(t.value) for t in targets])

    def complete(frame: DataFrame, looked_up: bool) -> DataFrame:
        cols = {}
        for t in targets:
            v = F.col(t.value)
            if not looked_up:
                found = []
            elif at:
                level = F.col(f"__l_{t.value}")
                found = [(F.when(level == i, F.col(f"__f_{t.value}")), names[i]) for i in range(len(levels))]
            else:
                found = [(F.col(f"__m{i}_{t.value}"), names[i]) for i in range(len(levels))]
            fb = t.fallback if t.fallback is not None else F.lit(None)
            cols[t.out] = F.coalesce(F.nullif(v, F.lit(0)), *[m for m, _ in found], fb).cast(DEC)
            if t.flag:
                cols[t.flag] = F.when(missing(t.value), YES).otherwise(NO)
            if t.level_col:
                lvl = F.when(~missing(t.value), OWN)
                for m, name in found:
                    lvl = lvl.when(m.isNotNull(), name)
                cols[t.level_col] = lvl.otherwise(FALLBACK)
        helper = [c for c in frame.columns if c.startswith(("__m", "__f_", "__l_")) or c == tag or at and c == at[0]]
        return frame.withColumns(cols).drop(*helper)

    # The groups of one level hold every row once.
    total = F.lit(stats.where(F.col("__set") == _set_id(levels, 0)).agg(F.sum("__rows")).first()[0] or 0)
    todo = df.where(any_missing)
    if at:
        parts = store.buckets(df.sparkSession)
        todo = _with_fills(todo, stored_fills(lambda: fill_runs(
            fills(source.where(any_missing), stats, levels, targets, total, at), targets, at, parts)), targets, at)
    else:
        for i in range(len(levels)):
            todo = _look_up(todo, stats, levels, i, targets, total)
    if lies_by:
        todo = todo.repartition(store.buckets(df.sparkSession), lies_by)
    return complete(df.where(~any_missing), False).unionByName(complete(todo, True))
