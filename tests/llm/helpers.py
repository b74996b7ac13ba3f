"""Small corpora for the corpus operators' tests."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# An extra column whose name an operator might use inside.
CLASHES = ("fp", "rep", "body", "features", "label", "key", "size", "ids", "n", "kept", "copies")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def edge_rows(seed=0, n=40):
    """Nulls in every column, empty and blank texts, copies, near copies,
    repeated rows, repeated ids, a hot source and one very long text."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    rows = [(i * 3 - 20, t, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(t)) for i, t in enumerate(base)]
    rows += [(1000 + i, base[0], "en", "s0", 1) for i in range(12)]
    rows += [(2000 + i, base[1].replace("w1", "W1", 1) + f" w{i}", "de", "s1", 1) for i in range(8)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (3002, " \t\n", "en", "s2", 3),
             (3003, "x", "en", None, 1), (None, base[2], "en", "s0", 5), (None, None, None, None, None),
             (3004, base[3], "en", "s1", 5), (3004, base[3], "en", "s1", 5), (3005, "a b", "en", "s2", 3),
             (3005, "c d", "en", "s2", 3), (3006, words(rng, 30_000, 5000), "en", "s2", 9),
             (3007, "ÀÉß İ ﬁ \U0001F600 " * 40, "fr", "s2", 9)]
    rng.shuffle(rows)
    return rows


def edge_frame(spark, seed=0, parts=3):
    return spark.createDataFrame(edge_rows(seed), SCHEMA).repartition(parts)


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
