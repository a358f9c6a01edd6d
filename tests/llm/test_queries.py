"""The registered queries: on the smallest tables against SQL, and on tables of edge cases."""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from fellwalk.llm import catalog, language_id, quality_knn, quality_rules
from fellwalk.llm.common import labelled
from fellwalk.sources.views import TABLES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op2_html_extraction": "page_id url text n_chars",
    "op3_quality_classifier": "doc_id held_out score predicted",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_simhash_dedup": "doc_id fingerprint component_id",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op10_embedding_dedup": "vec_id n_links component_id kept",
    "op11_edit_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op12_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_centroid_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}
HELD = {"op1_language_id": (4, 2), "op3_quality_classifier": (3, 1), "op8_lm_scoring": (7, 2)}
TEXT = " ".join(f"word{i % 83} of{i % 7}" for i in range(120))
#: Nulls, empty and blank texts, ties, repeated rows and ids, a long text; names clash with helper columns.
DOCS = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "de", "a"), (4, TEXT, "en", "a"), (5, TEXT, "en", "b"), (5, TEXT, "en", "b"), (5, TEXT + " more", "de", "c"), (6, "Über die Brücke 12", "de", None), (7, "12 34 !!", "en", "a"), (None, TEXT, "en", "a"), (None, None, None, None), (8, " ".join(f"w{i % 4999}" for i in range(40_000)), "de", "hot"), *((20 + i, f"{TEXT[i:]} tail {i}", "en", "hot") for i in range(30))]


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    ids, texts, langs, sources = (list(c) for c in zip(*DOCS, strict=True))
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs, "source": sources, "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
    docs |= {name: pa.array([7] * len(ids), pa.int64()) for name in ("copies", "starts", "gone_id", "mix_id", "whole", "key", "id", "slot", "size", "component", "score", "row_key", "quality")}
    pq.write_table(pa.table(docs), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 4, 4, 5, 8, 99, None, *range(20, 40)], pa.int64()), "quality": pa.array([0, 1, 0, 1, 0, 1, 1, *[k % 2 for k in range(20)]], pa.int64()), "toxic": pa.array([0] * 27, pa.int64())}), folder / "labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array([1, 2, 2, None], pa.int64()), "url": ["u", None, None, "v"], "html": [None, "", "<p>one paragraph of some words</p>", "<nav>x</nav>"], "text": [1, 2, 3, 4]}), folder / "pages.parquet")
    vectors = [None, [], [0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [float("nan"), 1.0], [1.0, None]]
    pq.write_table(pa.table({"vec_id": pa.array(range(8), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 8), "n_links": pa.array([5] * 8), "id": pa.array([5] * 8)}), folder / "embeddings.parquet")
    return str(folder)


def rows_of(name, folder):
    if name.startswith("op12"):  # the sources a, b, c, hot and the empty one
        return 600 * 5
    if name.startswith("op13"):  # no vector of 64 components
        return 0
    table = "pages" if name.startswith("op2") else "embeddings" if name.startswith("op10") else "documents"
    return pq.read_table(f"{folder}/{table}.parquet").num_rows


@pytest.mark.parametrize("name", list(COLUMNS))
def test_edge_cases(spark, edges, name):
    out = catalog.QUERIES[name](spark, edges)
    want = COLUMNS[name].split()
    assert out.columns[: len(want)] == want
    rows = out.collect()
    assert len(rows) >= rows_of(name, edges) if name == "op5_packing" else len(rows) == rows_of(name, edges)
    if name in HELD:
        n, r = HELD[name]
        assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % n == r) for x in rows)
    if name == "op7_simhash_dedup":
        assert all(re.fullmatch("[0-9a-f]{16}", x.fingerprint) for x in rows)
        assert {x.fingerprint for x in rows if x.doc_id in (1, 2, 3)} == {"0" * 16} and all(x.component_id == 1 for x in rows if x.doc_id in (1, 2, 3))
    if name == "op10_embedding_dedup":
        assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in rows) == [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 0, 6, True), (7, 0, 7, True)]


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, edges, tmp_path, name):
    for table in ("documents", "labels", "pages", "embeddings"):
        pq.write_table(pq.read_table(f"{edges}/{table}.parquet").slice(0, 0), tmp_path / f"{table}.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_on_edge_cases(spark, edges, tmp_path):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    schema = [(f.name, f.dataType) for f in docs.schema]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, edges).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in docs.schema] == schema
    pq.write_table(pq.read_table(f"{edges}/documents.parquet").slice(0, 0), tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(f"{edges}/labels.parquet").slice(0, 0), tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(map(str, df[columns].round(6).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_node_arrays_walk_as_trees():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (500, 4)).astype(float)  # many ties with the thresholds
    trees = quality_rules.grow(x, (x[:, 0] + x[:, 1] > 5).astype(float), np.array([1, 0, 0, -1]))

    def walk(node, row):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    want = [trees.prior + sum(walk(root, row) for root in trees.roots) for row in x]
    assert np.allclose(trees.margin(x), want, rtol=0, atol=1e-9)


def test_labels_without_documents_take_no_room(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(5)] + [(3, "a first text"), (None, "x")], "doc_id int, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)] + [(2, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.text, r.quality) for r in labelled(docs, labels, 5).collect())
    assert got == [(0, "t0", 0), (1, "t1", 1), (2, "t2", 1), (3, "a first text", 1), (4, "t4", 0)]


def test_neighbours_by_brute_force():
    """Exact cosines against every voter, ties at the last place to the first of them."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "bad", "plain", "text", "words"], 12)) for _ in range(60)]
    project = rng.standard_normal((quality_knn.TERMS, 6)).astype(np.float32)
    model = quality_knn.Voters(project, np.zeros((0, 6), np.float32), rng.integers(0, 2, 40).astype(float))
    model.vectors = model.latent([*texts[:20], *texts[:20]])  # every voter twice
    got = model.score([*texts, None, ""])
    for t, s in zip([*texts, None, ""], got, strict=True):
        near = (model.latent([t]) @ model.vectors.T)[0].astype(float)
        at = sorted(range(40), key=lambda k: (-round(near[k], 7), k))[: model.voters]
        w = np.clip(near[at], 0, 1) ** model.sharpness + 1e-9
        assert abs(s - (w * model.labels[at]).sum() / w.sum()) < 1e-4


def test_mixtures_by_brute_force():
    """Two languages: shares found by EM against a fine grid of shares, the set by the same penalty; small shares too."""
    rng = np.random.default_rng(2)
    letters = ["abcdefgh", "opqrstuv", "hijklmno"]
    word = lambda k: "".join(rng.choice(list(letters[k]), 5))
    logp = []
    for k in range(3):
        full = np.bincount(language_id.gram_bins(" ".join(word(k) for _ in range(4000))), minlength=language_id.BINS)
        logp.append(np.log((full + 0.5) / (full.sum() + 0.5 * language_id.BINS)))
    model = language_id.Mixture(["a", "b", "c"], np.array(logp))
    for share in (0.0, 0.03, 0.1, 0.3, 0.5):
        n = 400
        text = " ".join(word(1 if i < share * n else 0) for i in range(n))
        at, count = language_id.gram_counts(text)
        p = np.exp(model.logp[:, at])
        alone = (count * np.log(p[0])).sum()
        grid = np.linspace(0, 1, 2001)[1:-1]
        both = np.array([(count * np.log((1 - s) * p[0] + s * p[1])).sum() for s in grid])
        mixed = both.max() - max(alone, (count * np.log(p[1])).sum()) > model.penalty * np.log(count.sum())
        got = model.proportions(text)
        assert set(got) == ({"a", "b"} if mixed else {"a"}) and mixed == (share >= 0.1)
        if mixed:
            assert abs(got["b"] - grid[both.argmax()]) < 0.02
