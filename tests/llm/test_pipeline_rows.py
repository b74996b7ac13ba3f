"""The pipeline's rows against a plain Python chain; op1 with its own trees."""

import hashlib
import math
import re
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.helpers import SF
from tests.llm.test_dedup import components, slow_fingerprint
from tests.llm.test_mixing import plain_targets, size
from tests.llm.test_tokens import PATH, expect
from tests.llm.test_toxicity import corpus
from tillroll.llm import queries, toxicity


def plain_exact(rows):
    last = {}
    for r in rows:
        if r[1] not in last or r[0] > last[r[1]][0]:
            last[r[1]] = r
    return list(last.values())


def plain_near(rows):
    ids = [r[0] for r in rows]
    classes = components(ids, [slow_fingerprint(r[1] or "") for r in rows])
    return [r for r, c in zip(rows, classes, strict=True) if r[0] == c]


def plain_mix(rows):
    total, target = plain_targets(rows)
    out = []
    for s in total:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        left, keyed = math.floor(target[s]) - epochs * total[s], []
        for r in rows:
            if r[3] == s:
                text = r[1] or ""
                letters = len(re.sub(r"[^\w ]|[\d_]", "", text))
                w = 0.25 + 0.75 * (letters / len(text) if text else 0.0)
                u = (int(hashlib.md5(f"0|{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                keyed.append((-math.log(u) / w, r[0], r))
        for _, _, r in sorted(keyed, key=lambda k: k[:2]):
            n = size(r[1])
            part = max(0, min(n, left))
            left -= part
            out += [r] * (epochs + (part > 0 and 2 * part >= n))
    return out


def test_run_gives_the_rows_of_the_plain_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    toxic = {r.doc_id for r in queries.REGISTRY["op1_toxicity"](spark, SF).collect() if r.score >= 0.7}
    clean = [r for r in rows if r[0] not in toxic]
    steps = [clean, plain_exact(clean)]
    steps.append(plain_near(steps[-1]))
    steps.append(plain_mix(steps[-1]))
    assert len(rows) > len(steps[0]) > len(steps[1]) > len(steps[2]) > 0
    got = sorted(map(tuple, C.run(spark, SF).collect()), key=repr)
    assert got == expect(Tokenizer.from_file(PATH), steps[-1])


def test_held_out_rows_with_the_production_trees(spark):
    assert toxicity.TREES == 20
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth, by = {i: y for i, _, y in labels}, defaultdict(list)
    for r in toxicity.score_documents(docs, marks).collect():
        if r.held_out:
            by[truth[r.doc_id]].append(r.score)
    wins = sum((p > q) + .5 * (p == q) for p in by[1] for q in by[0])
    assert wins > .95 * len(by[1]) * len(by[0])
