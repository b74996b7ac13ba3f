"""Registered queries of the corpus operators: ``opN_<name>(spark, sf_dir)``.

Each applies its operator, with production parameters, to the whole table it
is meant for and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (bpe, exact_dedup, imatch, linededup, merkle, mixing, rans, repetition, simhash, spelling,
                          toxicity, urlrules, warc)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


MIX_SQL = r"""
    WITH d AS (
      SELECT doc_id, source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             0.25::DOUBLE + 0.75::DOUBLE * coalesce(
               length(regexp_replace(coalesce(text, ''), '[^\p{L} ]+', '', 'g'))::DOUBLE
               / nullif(length(coalesce(text, '')), 0), 0) AS w,
             (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
              + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM documents),
    s AS (SELECT source, sum(size)::DOUBLE AS source_size,
                 ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS wt
          FROM d GROUP BY source),
    l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
                     - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / wt, source NULLS LAST
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(wt) OVER (ORDER BY 2 * source_size / wt, source NULLS LAST
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM s),
    f AS (SELECT level FROM l WHERE level * wt <= 2 * source_size
          ORDER BY 2 * source_size / wt, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size, least(2 * source_size, (SELECT level FROM f) * wt) AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
    p AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs,
                 floor(e.target) - e.epochs * e.source_size
                 - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size::BIGINT AS source_size, target,
           (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken FROM p"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


@query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY body)""")
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


@query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    return linededup.line_classes(read(spark, sf_dir, "documents"), max_edits=None)


@query("op6_imatch_fingerprints")
def op6_imatch_fingerprints(spark, sf_dir):
    return imatch.edited_neighbours(read(spark, sf_dir, "documents"))


@query("op7_url_rules", r"""
    WITH p AS (
      SELECT page_id, coalesce(url, '') AS u, lower(coalesce(url, '')) AS low,
             translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
    r AS (
      SELECT page_id, host, path, low, CASE
        WHEN host SIMILAR TO '(.*\.)?example\.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN host SIMILAR TO '(.*\.)?example\.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN host SIMILAR TO '(.*\.)?com' AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN host SIMILAR TO '(.*\.)?com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN host SIMILAR TO '(.*\.)?org' AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM p)
    SELECT page_id, host, path, rule, CASE
      WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
      WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?spam-farm\..*/appeal([^a-z0-9_.%-]|$)')
        OR regexp_matches(low, '/robots\.txt$') THEN 'allow'
      WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?((ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.|doubleclick\.net([^a-z0-9_.%-]|$))')
        OR regexp_matches(low, '/adserver/|/banner/.*/img([^a-z0-9_.%-]|$)|/popunder\.|[^a-z0-9_.%-]affiliate_id=|[^a-z0-9_.%-]clickid=.*[^a-z0-9_.%-]sub=|\.exe$')
        THEN 'block' ELSE 'allow' END AS verdict FROM r""".replace("\\\\", "\\"))
def op7_url_rules(spark, sf_dir):
    return urlrules.filter_urls(read(spark, sf_dir, "pages")).drop("pattern")


@query("op8_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    f AS (SELECT *, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
                 min(page_id) OVER (PARTITION BY body) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""")
def op8_warc(spark, sf_dir):
    return warc.archive_round_trip(read(spark, sf_dir, "pages")).drop("payload")


@query("op9_rans_token_files")
def op9_rans_token_files(spark, sf_dir):
    back = rans.token_files(read(spark, sf_dir, "documents"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_bpe_chunk_reuse")
def op10_bpe_chunk_reuse(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_groups(spelling.document_words(read(spark, sf_dir, "documents")))


# crc32 of a short ASCII text: per byte one xor, then eight shifts (marked -1).
CRC_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""


def _leaf_sql(text: str) -> str:
    parts = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}::VARCHAR) || ':' || {p}::VARCHAR, '-')" for p in parts) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE_SQL = f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
             CASE WHEN {CRC_SQL} % 5 = 0 THEN {_leaf_sql(_LOWERED)} ELSE {_leaf_sql('text')} END AS changed
      FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                 count(*) OVER (PARTITION BY source) AS size FROM d),
    lv AS (
      SELECT source, 0 AS lvl, pos, size, leaf AS hash FROM n
      UNION ALL
      SELECT source, lvl + 1, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos))
      FROM lv WHERE size > 1 GROUP BY source, lvl, pos // 16, size),
    sub AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth,
                   count(*) OVER () AS trees FROM lv WHERE size = 1),
    tv AS (
      SELECT 0 AS lvl, nth AS pos, trees AS size, subroot AS hash FROM sub
      UNION ALL
      SELECT lvl + 1, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos))
      FROM tv WHERE size > 1 GROUP BY lvl, pos // 16, size),
    both_levels AS (
      SELECT s.nth AS tree, lvl, pos, size, hash FROM lv JOIN sub s ON s.source IS NOT DISTINCT FROM lv.source
      UNION ALL SELECT -1, lvl, pos, size, hash FROM tv),
    links AS (
      SELECT tree, lvl, pos, size,
             coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
             coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
      FROM both_levels WINDOW w AS (PARTITION BY tree, lvl, pos // 16 ORDER BY pos)),
    climb AS (
      SELECT n.doc_id, n.leaf, s.nth, s.nth AS tree, 0 AS lvl, n.pos, n.changed AS folded, '' AS siblings
      FROM n JOIN sub s ON s.source IS NOT DISTINCT FROM n.source
      UNION ALL
      SELECT c.doc_id, c.leaf, c.nth, CASE WHEN l.size > 1 THEN c.tree ELSE -1 END,
             CASE WHEN l.size > 1 THEN c.lvl + 1 ELSE 0 END, CASE WHEN l.size > 1 THEN c.pos // 16 ELSE c.nth END,
             CASE WHEN l.size > 1 THEN sha256(l.before || c.folded || l.after) ELSE c.folded END,
             CASE WHEN l.size > 1 THEN c.siblings || l.before || l.after ELSE c.siblings END
      FROM climb c JOIN links l ON l.tree = c.tree AND l.lvl = c.lvl AND l.pos = c.pos
      WHERE c.tree >= 0 OR l.size > 1),
    ends AS (SELECT c.* FROM climb c JOIN links l ON l.tree = c.tree AND l.lvl = c.lvl AND l.pos = c.pos
             WHERE c.tree = -1 AND l.size = 1),
    root AS (SELECT hash AS root FROM tv WHERE size = 1)
    SELECT e.doc_id, e.leaf, s.subroot, root.root, sha256(e.siblings) AS proof_sha256, e.folded AS folded_root,
           e.folded = root.root AS verified
    FROM ends e JOIN sub s ON s.nth = e.nth, root"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12_merkle_manifest(spark, sf_dir):
    return merkle.document_manifest(read(spark, sf_dir, "documents"))


def _windows_sql(n: int) -> str:
    """Per word: whether it lies in a window of n words that the text holds
    repeatedly (``every``), or that repeats an earlier one (``later``)."""
    key = "concat_ws(' ', " + ", ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))]) + ")"
    return f"""
    k{n} AS (SELECT r, pos, chars, CASE WHEN pos + {n - 1} <= total THEN {key} END AS key FROM w
             WINDOW o AS (PARTITION BY r ORDER BY pos)),
    f{n} AS (SELECT r, pos, chars, CASE WHEN key IS NULL THEN 0 ELSE (count(*) OVER (PARTITION BY r, key) > 1)::INT END AS every,
             CASE WHEN key IS NULL THEN 0 ELSE (row_number() OVER (PARTITION BY r, key ORDER BY pos) > 1)::INT END AS later FROM k{n}),
    c{n} AS (SELECT r, sum(every) AS every, sum(chars * later) AS later FROM (
               SELECT r, chars, max(every) OVER s AS every, max(later) OVER s AS later FROM f{n}
               WINDOW s AS (PARTITION BY r ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) GROUP BY r)"""


REPETITION_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
    l AS (SELECT r, unnest(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS word,
                 generate_subscripts(regexp_extract_all(body, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
    w AS (SELECT r, word, pos, length(word) AS chars, count(*) OVER (PARTITION BY r) AS total FROM l),
    t AS (SELECT r, count(*) AS n_words, sum(chars)::BIGINT AS word_chars FROM w GROUP BY r),
    x AS (SELECT r, unnest(string_split(body, chr(10))) AS line,
                 generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM d),
    y AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS again FROM x
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    z AS (SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines,
                 coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (again), 0) AS dup_line_chars
          FROM y GROUP BY r),""" + ",".join(map(_windows_sql, repetition.WINDOW_PERCENT)) + r""",
    a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                 length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c8.every, 0)::BIGINT AS n_repeat_words,
                 coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
                 """ + " AND ".join(f"100 * coalesce(c{n}.later, 0) <= {p} * coalesce(word_chars, 0)"
                                    for n, p in repetition.WINDOW_PERCENT.items()) + """ AS fine
          FROM d LEFT JOIN t USING (r) LEFT JOIN z USING (r) """ + " ".join(
              f"LEFT JOIN c{n} ON c{n}.r = d.r" for n in repetition.WINDOW_PERCENT) + """),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND fine AND 100 * n_dup_lines <= 30 * n_lines
             AND 100 * dup_line_chars <= 20 * word_chars AS kept FROM b"""


@query("op13_repetition_rules", REPETITION_SQL)
def op13_repetition_rules(spark, sf_dir):
    return repetition.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
