"""Merkle manifest of a table, proofs climbed by a recursive query (operator 12).

Every row is a leaf: the SHA-256 of its columns. Leaves of one source, in order
of id, are hashed in runs of ``ARITY`` to nodes, these again, up to the source's
subroot; the subroots, in order of source, likewise to the root.

1. Leaves are numbered within their source by ranges: a range's rows are counted,
   the counts before it in its source are its offset, so a source that holds a
   third of all rows is never sorted in one task.
2. Levels are built bottom up, one grouped aggregate of at most ``ARITY`` digests
   a node each, and stored as node rows linked to their parent:
   ``id, parent, before, after``, the digests of the run's other nodes to the left
   and to the right.
3. A recursive query climbs from the leaves to the root. Per step it joins the
   parent link, appends the siblings to the proof and folds the leaf's digest with
   them. The leaves of a run share all links above it, so a climbing row is a run:
   it holds one digest to fold for each of its leaves and the shared siblings once
   (per leaf, siblings of six levels would be 2.9 kB and more than the table).

Inputs of a hash are hex digests as text; inside, digests are kept as bytes.
A column is hashed as ``-`` if null, else as its length in UTF-8 bytes, ``:`` and
its value. The null source comes first, null ids first within a source; rows with
one source and id are ordered by their digest, equal rows are interchangeable.
A row with a null id is never tampered with. Empty and long texts are hashed
whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stage

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_ONE_IN = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(data: Column) -> Column:
    """Digest (bytes) of concatenated digests, whose hex text is hashed."""
    return F.unhex(F.sha2(F.lower(F.hex(data)), 256))


def leaf_digest(values: list[Column]) -> Column:
    """Hex digest of a row's column values."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, changed``: digests of each row and of its tampered form."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_ONE_IN == 0
    values = [F.col(c) for c in COLUMNS]
    leaf = leaf_digest(values)
    changed = leaf_digest([*values[:-1], lower_ascii(F.col("text"))])
    return docs.select("source", "doc_id", leaf.alias("leaf"), F.when(tampered, changed).alias("changed")).select(
        "source", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("changed"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` plus ``place`` (from 0 within ``group``) and ``size`` of the group.

    ``group`` is a string without nulls. Ranges over group and order, ties dealt by
    row, bound what a task sorts; the windows hold a range, and one row per range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = stage(rows.withColumn("__tie", F.monotonically_increasing_id()), "merkle-rows")
    keys = [F.col(c).asc_nulls_first() for c in (*order, "__tie")]
    ranged = stage(fixed.repartitionByRange(parts, F.col(group).asc(), *keys)
                   .withColumn("__part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
                            F.sum("__n").over(whole).alias("size"))
    inside = Window.partitionBy(group, "__part").orderBy(*keys)
    return (ranged.withColumn("__row", F.row_number().over(inside)).join(offsets, [group, "__part"])
            .withColumn("place", F.col("__offset") + F.col("__row") - 1)
            .drop("__tie", "__part", "__offset", "__row"))


def _runs_of(n: Column) -> Column:
    return F.call_function("div", n + (ARITY - 1), F.lit(ARITY))


def _run(place: str) -> Column:
    return F.call_function("div", F.col(place), F.lit(ARITY))


def leaf_runs(leaves: DataFrame) -> DataFrame:
    """The lowest nodes: ``tree, place, size, id, digest, members`` per run of
    leaves; ``size`` counts the nodes of the tree's level. A lone leaf is its own node."""
    member = F.struct(F.col("place").alias("at"), "doc_id", "leaf", "changed")
    runs = leaves.groupBy("tree", "size", _run("place").alias("run")).agg(
        F.sort_array(F.collect_list(member)).alias("members"))
    both = F.when(F.col("size") == 1, F.unhex(F.element_at("members.leaf", 1))).otherwise(
        F.unhex(F.sha2(F.array_join("members.leaf", ""), 256)))
    return runs.select("tree", F.col("run").alias("place"), _runs_of(F.col("size")).alias("size"),
                       F.concat_ws(".", "tree", F.lit("1"), "run").alias("id"), both.alias("digest"),
                       (F.col("size") == 1).alias("lone"), "members")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The next level of every tree that has several nodes, with its children."""
    kids = F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), "id", F.lower(F.hex("digest")).alias("hex"))))
    return (nodes.where("size > 1").groupBy("tree", "size", _run("place").alias("run")).agg(kids.alias("kids"))
            .select("tree", F.col("run").alias("place"), _runs_of(F.col("size")).alias("size"),
                    F.concat_ws(".", "tree", F.lit(str(level)), "run").alias("id"),
                    F.unhex(F.sha2(F.array_join("kids.hex", ""), 256)).alias("digest"), "kids"))


def _links(parents: DataFrame) -> DataFrame:
    """Parent-linked node rows ``id, parent, before, after``."""
    each = parents.select(F.col("id").alias("parent"), F.col("kids.hex").alias("hexes"),
                          F.posexplode("kids").alias("i", "kid"))
    left = F.slice("hexes", F.lit(1), F.col("i"))
    right = F.slice("hexes", F.col("i") + 2, F.lit(ARITY))
    return each.select(F.col("kid.id").alias("id"), "parent", F.unhex(F.array_join(left, "")).alias("before"),
                       F.unhex(F.array_join(right, "")).alias("after"))


def _climb_levels(nodes: DataFrame, widest: int, first_level: int) -> tuple[DataFrame, list[DataFrame]]:
    """Builds level by level until every tree has one node: those, and the links."""
    done, links, level = nodes.where("size = 1"), [], first_level
    done = done.select("tree", "id", "digest")
    while widest > 1:
        nodes = stage(_parents(nodes, level), "merkle-level")
        links.append(_links(nodes))
        done = done.unionByName(nodes.where("size = 1").select("tree", "id", "digest"))
        widest, level = -(-widest // ARITY), level + 1
    return done, links


# The loop is planned before its rows are known, and links grow with the table:
# the join is a shuffled one at every size.
CLIMB = """
    WITH RECURSIVE climb (start, node, folded, siblings) AS (
      SELECT id, id, folded, unhex('') FROM {starts}
      UNION ALL
      SELECT /*+ SHUFFLE_MERGE(l) */ c.start, l.parent,
             transform(c.folded, f -> unhex(sha2(lower(hex(concat(l.before, f, l.after))), 256))),
             concat(c.siblings, l.before, l.after)
      FROM climb c JOIN {links} l ON l.id = c.node)
    SELECT start, node, folded, siblings FROM climb"""


def climb(starts: DataFrame, links: DataFrame, top: str) -> DataFrame:
    """``start, folded, siblings`` at the node ``top``: every row of ``starts``
    (``id, folded``: digests at that node) climbed along ``links``, as a stored table."""
    spark = starts.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")      # the rows climb at most log(rows) levels; no row may be cut off
    try:
        reached = spark.sql(CLIMB, starts=starts, links=links).where(F.col("node") == top).drop("node")
        return stage(reached, "merkle-climb")
    finally:
        spark.conf.set(limit, before)


def manifest(leaves: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of the
    rows ``source, doc_id, leaf, changed`` (hex digests)."""
    spark = leaves.sparkSession
    keyed = leaves.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
                          "doc_id", "leaf", "changed")
    placed = stage(numbered(keyed, "key", ["doc_id", "leaf"]), "merkle-placed")
    sources = numbered(placed.groupBy("key").agg(F.max("size").alias("rows")).withColumn("all", F.lit("")),
                       "all", ["key"])
    sources = stage(sources.select("key", "rows", F.col("place").alias("nth"), F.col("size").alias("trees")),
                    "merkle-sources")
    counts = sources.agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("trees")).first()
    if not counts["trees"]:
        return spark.createDataFrame([], f"doc_id {dict(leaves.dtypes)['doc_id']}, leaf string, subroot string, "
                                     "root string, proof_sha256 string, folded_root string, verified boolean")
    # A tree is named by its source's place, which is short whatever the source's name.
    named = placed.join(sources.select("key", F.col("nth").cast("string").alias("tree")), "key")
    runs = stage(leaf_runs(named), "merkle-runs")
    subroots, links = _climb_levels(runs, -(-counts["rows"] // ARITY), 2)
    subroots = stage(subroots, "merkle-subroots")
    top = subroots.select(F.lit("top").alias("tree"), F.col("tree").cast("long").alias("place"),
                          F.lit(counts["trees"]).cast("long").alias("size"), "id", "digest")
    root, upper = _climb_levels(top, counts["trees"], 1)
    root = root.first()
    links += upper
    no_links = spark.createDataFrame([], "id string, parent string, before binary, after binary")
    linked = no_links
    for level in links:
        linked = linked.unionByName(level)
    linked = stage(linked, "merkle-links")

    hexes = F.col("members.leaf")
    left = lambda i: F.array_join(F.slice(hexes, F.lit(1), i), "")             # noqa: E731
    right = lambda i: F.array_join(F.slice(hexes, i + 2, F.lit(ARITY)), "")
    folded = F.transform("members", lambda m, i: F.when(F.col("lone"), F.unhex(m["changed"])).otherwise(
        F.unhex(F.sha2(F.concat(left(i), m["changed"], right(i)), 256))))
    climbed = climb(runs.select("id", folded.alias("folded")), linked, root["id"])
    each = (runs.join(climbed, F.col("id") == F.col("start"))
            .join(subroots.select("tree", F.lower(F.hex("digest")).alias("subroot")), "tree")
            .select("subroot", "folded", "siblings", F.col("members.leaf").alias("hexes"),
                    F.posexplode("members").alias("i", "m")))
    others = F.array_join(F.filter("hexes", lambda h, j: j != F.col("i")), "")
    folded_root = F.lower(F.hex(F.get("folded", F.col("i"))))
    root_hex = F.lit(bytes(root["digest"]).hex())
    return each.select(F.col("m.doc_id").alias("doc_id"), F.col("m.leaf").alias("leaf"), "subroot",
                       root_hex.alias("root"),
                       F.sha2(F.concat(others, F.lower(F.hex("siblings"))), 256).alias("proof_sha256"),
                       folded_root.alias("folded_root"), (folded_root == root_hex).alias("verified"))


def document_manifest(docs: DataFrame) -> DataFrame:
    return manifest(document_leaves(docs))
