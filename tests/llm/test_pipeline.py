import hashlib
import random
import re

import numpy as np

import corpus_pipeline
from bidlake.llm import pii
from test_llm_edges import brute_terms
from test_llm_operators import WORDS, tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_steps(spark, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    low = {i: i for i in rows}
    changed = True
    pairs = [(i, j) for i in rows for j in rows if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    left = {i for i in rows if low[i] == i and re.search(r"[^\W\d_]", rows[i]) and not any(x in rows[i] for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == left
    said = brute_terms([rows[i] for i in left])
    for i, r in got.items():
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W_]+", rows[i]) if m[0].lower() in said]
        base = pii.base_spans(rows[i])
        text = pii.redacted(rows[i], base + [t for t in terms if not any(a < t[2] and t[1] < b for _, a, b in base)])
        ids = tokenizer[1].encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_of_odd_rows(spark, tmp_path):
    story = " ".join(random.Random(1).choices(WORDS["en"], k=60))
    rows = [(1, story), (1, story), (None, "another story of " + " ".join(random.Random(2).choices(WORDS["en"], k=60))), (2, None), (3, ""), (4, "½ 12"), (None, None), (5, story + "and some more of it")]
    frame = spark.createDataFrame([(i, t, "en", None, len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == [1, None]
    frame.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    again = {r.doc_id: r.text for r in corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()}
    assert not any(pii.base_spans(t) for t in again.values())
