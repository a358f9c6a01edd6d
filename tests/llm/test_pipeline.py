import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from fellwalk.llm import packing, quality_rules, substring_dedup
from fellwalk.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_follow_each_other(spark, tmp_path):
    docs = table(spark, SF, "documents")
    schema, rows = docs.schema, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows[k] = docs.collect()
        assert rows[k], name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
    before = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    # 4: whatever fails the base rule is gone, what stays is unchanged
    for r in rows[0]:
        assert r.asDict() == before[r.doc_id]
        n, _, _, _, again = quality_rules.statistics(__import__("pyarrow").array([r.text]))[0][0]
        assert n >= 50 and 100 * again <= 50 * n
    # 7: exact copies leave one, the smallest
    first = {}
    for r in rows[0]:
        first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    assert {r.doc_id for r in rows[1]} <= set(first.values()) and len(rows[1]) >= 0.8 * len(first)
    # 9: no window of 50 words is left that starts in an earlier document of the input
    seen = {}
    for r in sorted(rows[1], key=lambda r: r.doc_id):
        w = r.text.encode().split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), r.doc_id)
    text = {r.doc_id: r.text for r in rows[1]}
    for r in rows[2]:
        w = text[r.doc_id].encode().split()
        gone = {k for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] < r.doc_id for k in range(i, i + 50)}
        assert [x for k, x in enumerate(w) if k not in gone] == r.text.encode().split() and r.n_chars == len(r.text)
    # 6: copies of whole documents, three at most
    assert max(Counter(r.doc_id for r in rows[3]).values()) <= 3
    # 5: every token of every copy is in one window
    encode = packing.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    want = sum(len(encode(r.text)) + 1 for r in rows[3])
    assert sum(r.length for r in rows[4]) == want
    filled = Counter()
    for r in rows[4]:
        filled[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
    assert corpus_pipeline.ORACLE_SQL is None and substring_dedup.WINDOW == 50


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
