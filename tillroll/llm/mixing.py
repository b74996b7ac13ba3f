"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2).

Targets. Sources (by code point, null last) take the weights 3, 1, 2 in turn
and share ``share`` times all words. No target exceeds ``max_epochs`` times its
source's words; what exceeds is dealt again by weight until no target is
above. That is min(cap, level * weight) for one level, which a running sum over
the sources sorted by cap / weight yields directly.

Selection. A source's target is met by complete epochs of all its documents
first. The fraction left goes to the documents with the smallest exponential
keys -ln(u) / w, where u is a hash of the document's id and w its quality weight:
sampling without replacement with probability proportional to weight. A
prefix sum over the sorted keys stops at the word budget; the document at the
edge is taken for the words still missing (``taken``), or, as whole copies,
when at least half of it is (``copies``).

A source may hold a third of all rows: the keys are cut into ranges of about
``RANGE_ROWS`` documents, sums per range give each range its offset, and only
within a range are rows sorted, so no task gathers a source.

Definitions: null text has size 0; a document of size 0 takes 0 words and as
many copies as its source has complete epochs. Null sources form one source.
Equal keys are ordered by id, then text hash. A source with no words has
target 0. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stage, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
RANGE_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_words(text_col: str = "text"):
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def quality_weight(text_col: str = "text"):
    """1 for prose, down to 1/4: the share of letters and blanks in the text."""
    text = text_or_empty(text_col)
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.lit(0.25) + F.lit(0.75) * F.coalesce(
        letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def uniform(id_col: str, seed: int):
    """(0, 1), fixed by the seed and the document's id, 52 bits."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
              .cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, share_percent: int = SHARE_PERCENT,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_rows, source_size, target)``, one row per source.

    ``sizes(source, size)``. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count(F.lit(1)).alias("source_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = per.withColumn("weight", F.element_at(
        weights, ((F.row_number().over(order) - 1) % len(WEIGHTS)) + 1).cast("long"))
    # Sorted by cap / weight, the first sources are capped; the level is that of
    # the first source whose cap reaches it.
    cap = F.col("source_size") * max_epochs
    up = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    place = F.row_number().over(up)
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * share_percent / 100.0
    level = ((budget - F.coalesce(F.sum(cap).over(below), F.lit(0))) / F.sum("weight").over(rest))
    leveled = ranked.withColumn("level", level).withColumn("place", place).withColumn(
        "open", F.col("level") * F.col("weight") <= cap)
    final = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(
        Window.partitionBy())["level"]
    return leveled.select("source", "source_rows", "source_size",
                          F.least(cap.cast("double"), F.coalesce(
                              final * F.col("weight"), cap.cast("double"))).alias("target"))


def mix(docs: DataFrame, seed: int = 0, share_percent: int = SHARE_PERCENT,
        max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``doc_id, source, text_hash, size, source_size, target, taken, copies`` per row."""
    lean = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
        size_words(text_col).alias("size"), quality_weight(text_col).alias("weight"))
    u = uniform("doc_id", seed)
    lean = stage(lean.withColumn("key", -F.log(u) / F.col("weight")), "mix")
    targets = source_targets(lean.select("source", "size"), share_percent, max_epochs).withColumn(
        "ranges", F.ceil(F.col("source_rows") / F.lit(RANGE_ROWS))).withColumn(
        "epochs", F.when(F.col("source_size") > 0,
                         F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long")))
    targets = targets.withColumn("left_over", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    t = targets.select(F.col("source").alias("s"), "ranges", "source_size", "target", "epochs", "left_over")
    # 1 - exp(-key) is monotone in the key and spreads the ranges evenly.
    rows = lean.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "range", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("ranges")))
    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = per_range.select(F.col("source").alias("rs"), F.col("range").alias("rr"), before.alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
              .join(offsets, F.col("source").eqNullSafe(F.col("rs")) & (F.col("range") == F.col("rr"))))
    part = F.greatest(F.lit(0).cast("long"), F.least(
        F.col("size"), F.col("left_over") - F.col("offset") - F.col("inner")))
    return (placed.withColumn("part", part)
            .select("doc_id", "source", "text_hash", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
                    (F.col("epochs") + ((F.col("part") * 2 >= F.col("size")) & (F.col("part") > 0))
                     .cast("long")).alias("copies")))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; same columns."""
    options = {"id_col": "doc_id", "text_col": "text", **options}
    picked = (mix(docs, **options).where("copies > 0")
              .select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                      F.col("text_hash").alias("__hash"), "copies")
              # A row that the table repeats has several counts; they are added up and
              # dealt to one of the repeats.
              .groupBy("__id", "__source", "__hash").agg(F.sum("copies").alias("__copies")))
    own = docs.withColumn("__own", F.xxhash64(text_or_empty(options["text_col"])))
    source = options.get("source_col", "source")
    hit = own.join(picked, F.col(options["id_col"]).eqNullSafe(F.col("__id"))
                   & (F.col("__own") == F.col("__hash")) & F.col(source).eqNullSafe(F.col("__source")))
    nth = F.row_number().over(Window.partitionBy(options["id_col"], "__own", source).orderBy(F.lit(1)))
    return (hit.withColumn("__nth", nth).where("__nth = 1")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
            .select(*docs.columns))
