import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fellwalk.llm import language_id, ngram_lm, packing, quality_knn, quality_rules, substring_dedup
from fellwalk.llm.common import Tokens, chunks
from fellwalk.llm.elias_fano import EliasFano

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two, THREE four\nfive"), (6, "One two, THREE four\nfive"), (6, "One two, THREE four\nfive"), (7, LONG), (8, LONG), (None, "no id here"), (9, "é à 中文 — ok"), (10, "123 !!"), (11, "a b c a b c a b c a b c")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i == 4 else "s", len(t or ""), 0.5) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


texts = st.lists(st.sampled_from(["a", "B", "c,", "é", " ", "\n", "\t", "\x0b", " ", "aa"]), max_size=40).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), texts), min_size=1, max_size=8), st.booleans())
def test_tokens_of_slices(ts, lower):
    a = pa.array(ts, pa.string()).slice(len(ts) // 3)
    tok = Tokens(a, lower)
    want = [words(t.encode().lower().decode() if lower and t else t) for t in a.to_pylist()]
    flat = tok.words.take(pa.array(tok.codes)).to_pylist()
    got = [[w.encode() for w in flat[i:j]] for i, j in zip(tok.offsets, tok.offsets[1:], strict=False)]
    assert got == want
    h = tok.hashes()
    assert len({(w, x) for w, x in zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_chunks_keep_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 900, 3, 3, 3)])], ["text"])
    parts = list(chunks([b], size=10))
    assert sum(p.num_rows for p in parts) == 6 and [t for p in parts for t in p.column(0).to_pylist()] == b.column(0).to_pylist()


# --- quality rules


def brute_statistics(t):
    w = words(t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "#x", "\n", "é|", "\n"]), max_size=60).map(" ".join))
def test_base_counts(t):
    base, _ = quality_rules.statistics(pa.array([t, None]))
    assert tuple(base[0]) == brute_statistics(t) and tuple(base[1]) == (0, 0, 0, 0, 0)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * rng.random(2000) < 0.7).astype(float)
    trees = quality_rules.grow(x, y, np.array([-1, 0, 1]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.93
    for j, sign in ((0, -1), (2, 1)):
        line = np.repeat(x[:200], 50, 0).reshape(200, 50, 3)
        line[:, :, j] = np.linspace(0, 1, 50)
        s = trees.score(line.reshape(-1, 3)).reshape(200, 50)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()
    assert (quality_rules.grow(x[:0], y[:0], np.zeros(3)).score(x) > 0.5).all()


def test_rules_on_edges(spark, edges, empty):
    labels = spark.createDataFrame([(7, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trees = quality_rules.fit(edges, labels)
    rows = quality_rules.apply_rules(edges, trees).collect()
    assert len(rows) == len(EDGES)
    texts_of = defaultdict(list)
    for i, t in EDGES:
        texts_of[i].append(t)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in [brute_statistics(t) for t in texts_of[r.doc_id]]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(empty, quality_rules.fit(empty, labels.limit(0))).count() == 0
    kept = quality_rules.filter_documents(edges, trees)
    assert kept.schema == edges.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


# --- language identification


def test_language(spark, edges, empty):
    two = {"en": "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun ", "fr": "le renard brun saute par dessus le chien paresseux et puis il dort au soleil chaud "}
    docs = spark.createDataFrame([(k, (two[x] * 4), x) for k, x in enumerate(["en", "fr"] * 10)] + [(50, two["en"] * 6 + two["fr"] * 3, None), (51, "...", None), (52, None, "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 20"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 == 0 else "fr") and got[k].score > 0.95 for k in range(20))
    assert got[50].lang_pred == "en" and 0.55 < got[50].score < 0.8 and set(got[50].shares) == {"en", "fr"}
    assert (got[51].lang_pred, got[51].score, got[52].lang_pred) == ("und", 0.0, "und")
    rows = language_id.identify(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.identify(edges, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


# --- nearest neighbours


def test_neighbours(spark, edges, empty):
    good = [(k, " ".join(f"plain{(k * 7 + i) % 50} words," for i in range(60)), 1) for k in range(40)]
    bad = [(100 + k, " ".join(f"JUNK{(k * 3 + i) % 9}!!! $$$" for i in range(60)), 0) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad], "doc_id long, quality int, toxic int")
    model = quality_knn.fit(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    held = quality_knn.score_documents(docs.where("doc_id % 2 = 1"), model).collect()
    assert all((r.predicted == 1) == (r.doc_id < 100) for r in held)
    block = [t for _, t, _ in good[:3] + bad[:3]]
    near = model.latent(block) @ model.vectors.T  # brute force of the vote
    for row, s in zip(near, model.score(block), strict=True):
        at = np.argsort(-row)[: model.voters]
        w = np.clip(row[at], 0, 1).astype(float) ** model.sharpness + 1e-9
        assert abs((w * model.labels[at]).sum() / w.sum() - s) < 1e-6
    rows = quality_knn.score_documents(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_knn.score_documents(edges, quality_knn.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_knn.score_documents(empty, model).count() == 0


# --- packing



def checked(rows, docs, size):
    """Holds (window, pieces) against the documents: every id once, no gap in a window, no padding; returns the pieces' windows."""
    seen, windows = defaultdict(dict), set()
    for window, pieces in rows:
        assert window not in windows
        windows.add(window)
        n = sum(len(p.ids) for p in pieces)
        assert n == size or n < size and n & (n - 1) == 0
        for p in pieces:
            ids = docs[p.doc][1]
            assert p.tokens == len(ids) and (ids[p.start : p.start + len(p.ids)] == p.ids).all() and len(p.ids)
            seen[p.doc][p.start] = len(p.ids)
    for doc, ids in docs:
        at = 0
        for start in sorted(seen[doc]):
            assert start == at
            at += seen[doc][start]
        assert at == len(ids)


def packed(docs, size, parts):
    """As partitions do it: (rows, ids that were settled)."""
    rows, still = [], []
    for k in range(parts):
        for w, pieces, is_open in packing.pack_documents(iter(docs[k::parts]), k << 36, size):
            (still if is_open else rows).append((w, pieces))
    span = packing.TOGETHER
    while len(still) and max(w for w, _ in still) >> 36 >= span:
        groups = defaultdict(list)
        for w, pieces in sorted(still, key=lambda x: x[0]):
            groups[(w >> 36) // span].append((w, pieces))
        still, span = [], span * packing.TOGETHER
        for g in groups.values():
            for w, pieces, is_open in packing.pack_on(g, None, size):
                (still if is_open else rows).append((w, pieces))
    last = [(w, pieces) for w, pieces, _ in packing.pack_on(sorted(still, key=lambda x: x[0]), 1 << 62, size)]
    return rows + last, sum(len(p.ids) for w, pieces in last for p in pieces if w >= 1 << 62)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60), st.integers(1, 4))
def test_packing_is_exact_and_unpadded(lengths, parts):
    docs = [(k, np.arange(n, dtype=np.uint32) + 1000 * k) for k, n in enumerate(lengths)]
    checked(packed(docs, 64, parts)[0], docs, 64)


@pytest.mark.parametrize("kind", ["mixed", "never fit", "halves", "tiny"])
def test_little_is_settled_and_open_windows_are_bounded(kind):
    rng = np.random.default_rng(4)
    n = 10_000
    lengths = {"mixed": rng.lognormal(5.5, 1.2, n).astype(int) % 6000 + 1, "never fit": np.full(n, 1100), "halves": np.where(np.arange(n) % 2, 1024, 1030), "tiny": rng.integers(1, 30, 10 * n)}[kind]
    docs = [(k, np.zeros(m, np.uint32)) for k, m in enumerate(lengths.tolist())]
    rests = sum(m % 2048 for m in lengths.tolist())
    for parts in (4, 64, 256):  # what is settled does not grow with the number of partitions
        rows, settled = packed(docs, 2048, parts)
        checked(rows, docs, 2048)
        assert settled < max(0.01 * rests, 4 * packing.LEVELS * 2048), (parts, settled, rests)
    left = sum(is_open for _, _, is_open in packing.pack_documents(iter(docs), 0, 2048))
    assert left < 4 * packing.LEVELS


def test_open_windows_of_many_partitions_are_packed_in_rounds(spark):
    """70 partitions of one or two documents need three rounds; the pieces are those of every document, without padding."""
    docs = spark.range(100).selectExpr("id AS doc_id", "repeat('word ', CAST(1 + id % 17 * 40 AS INT)) AS text").repartitionByRange(70, "doc_id")
    rows = packing.pack_public(docs).collect()
    windows, by = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        by[r.doc_id].append(r)
    assert len(by) == 100 and all(sum(r.length for r in p) == p[0].doc_tokens for p in by.values())
    fills = []
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert all(a.offset + a.length == b.offset for a, b in zip(w, w[1:])) and w[0].offset == 0
        fills.append(w[-1].offset + w[-1].length)
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills) and sum(n < 2048 for n in fills) <= 11


def test_placing_takes_the_least_sum_of_squares():
    """Every move is one of least cost among all: into any open window, whole or cut, or into a new one."""
    rng = np.random.default_rng(0)
    rule = packing.SumOfSquares(20, levels=10, price=1)
    level = lambda fill: (fill - 1) // 2
    for k, n in enumerate(rng.integers(1, 20, 600).tolist()):
        before = [fill for _, fill, _ in rule.left()]

        def cost(fills):
            c = Counter(level(f) for f in fills if f < 20)
            return sum(v * v for v in c.values())

        def after(i, n=n, before=before):
            rest = before[:i] + before[i + 1 :]
            full = before[i] + n
            return (cost([*rest, full]), full > 20) if full <= 20 else (cost([*rest, full - 20]) + 1, True)

        tops = [[w[1] for w in stack][-1] for stack in rule.open if stack]
        choices = [(cost([*before, n]), False)] + [after(before.index(t)) for t in tops]
        best = min(c for c, _ in choices)
        full = list(rule.place(k, [packing.Piece(k, 0, np.zeros(n, np.uint32), n)]))
        now = cost([fill for _, fill, _ in rule.left()])
        assert now <= best  # a cut document's rest is placed again, which can only save more
        assert all(sum(len(p.ids) for p in pieces) == 20 for _, pieces in full)
        assert sum(rule.count) == len(rule.left()) and all(rule.count[c] == len(rule.open[c]) for c in range(10))


def test_millions_of_blanks():
    P = pytest.importorskip("public_tokenizers")
    encode = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000 + "b"):
        assert encode(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids


def test_packing_edges(spark, edges, empty):
    P = pytest.importorskip("public_tokenizers")
    encode = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    slow = packing.Encoder(P.path("byte_bpe_50k.json"))
    for t in ["", " ", "a <|endoftext|> b", "Ünïcode 中文  \n\n x", LONG[:5000], "é" * 3000, "\x1c\x85　 1²³"]:
        assert encode(t).tolist() == slow(t).tolist() == slow.slow.encode(t, add_special_tokens=False).ids
    rows = packing.pack_public(edges).collect()
    assert sum(r.length for r in rows) == sum(len(slow(t or "")) + 1 for _, t in EDGES)
    assert packing.pack_public(empty).count() == 0


# --- repeated passages


def brute_removed(docs, n):
    least = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and least[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 4, 7])
def test_substrings(spark, n):
    rng = np.random.default_rng(n)
    base = [" ".join(rng.choice(list("abcdefg"), 60)) for _ in range(4)]
    docs = [(int(k), " ".join([base[k % 4][: 2 * int(rng.integers(5, 50))], *rng.choice(list("abcxyz"), 9), base[(k + 1) % 4][30:80].strip()])) for k in range(30)]
    docs += [(40, "a " * 50), (41, " a" * 40), (42, "x a a a a a a a a a b"), (43, None), (44, ""), (None, base[0]), (3, docs[3][1]), (3, "other " + base[2]), (45, docs[5][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, starts int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed_words(df, n).collect()), key=str)
    assert got == brute_removed(docs, n)
    assert substring_dedup.removed_words(df.limit(0), n).count() == 0


def test_windows_travel_small(spark):
    """As laid out, rows of a document differ from the one before in one stretch: 19 bytes are enough for one (LZ4, rows dealt by window)."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(500)], 4000)) for _ in range(4)]
    docs = spark.createDataFrame([(1000 + i, texts[i % 4] + f" end{i}") for i in range(8)], "doc_id long, text string").coalesce(1)
    every = spark.sparkContext.broadcast(np.full(64, ~np.uint64(0)))
    rows = substring_dedup.window_rows(substring_dedup._keyed(docs), 50, every).toPandas()
    laid = np.zeros((len(rows), 2 * len(rows.columns) + 3), np.int32)  # as Spark does: length, nulls, eight bytes a column
    laid[:, 0] = 8 * (len(rows.columns) + 1)
    for k, c in enumerate(rows.columns):
        laid[:, 3 + 2 * k : 5 + 2 * k] = rows[c].to_numpy(np.int64).view(np.int32).reshape(-1, 2)
    parts = [laid[rows["window"] % 8 == k].tobytes() for k in range(8)]
    assert len(rows) > 30_000 and sum(len(pa.compress(p, "lz4_raw")) for p in parts) < 19 * len(rows)
    assert sorted(rows["tail"].to_numpy(np.int64)[rows["doc_id"] == 1000] >> substring_dedup.CHECK_BITS) == list(range(4001 - 49))


def test_cut_texts(spark):
    a = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, f"lead {a}\nend", 0), (2, f"other\n{a}  tail  here", 0), (3, a, 0), (4, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in substring_dedup.dedup_documents(df).collect()}
    assert set(got) == {1, 2, 4} and got[2].text == "other  tail  here" and got[2].n_chars == len(got[2].text) and got[1].text == f"lead {a}\nend"


# --- language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.lists(st.integers(0, 1 << 41), min_size=1, max_size=40))
def test_elias_fano(values, queries):
    v = np.array(sorted(values), np.int64)
    e = EliasFano.encode(v)
    assert (e.access(np.arange(len(v))) == v).all()
    x = np.array(queries + values[:20], np.int64)
    at, hit = e.successor(x)
    assert (at == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()


def brute_model(texts, least=ngram_lm.LEAST_COUNT):
    toks = [[*(w.lower() for w in words(t)), "END"] for t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w in toks:
        c1.update(w)
        c2.update(zip(w, w[1:], strict=False))
        c3.update(zip(w, w[1:], w[2:], strict=False))
    n, v, d = sum(c1.values()), len(c1), ngram_lm.DISCOUNT
    s2, s3 = Counter(), Counter()
    for (a, _), k in c2.items():
        s2[a] += (k - d) * (k >= least)
    for (a, b, _), k in c3.items():
        s3[a, b] += (k - d) * (k >= least)
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)

    def p2(a, b):
        return p1(b) if c1[a] < least else max(c2[a, b] - d, 0) * (c2[a, b] >= least) / c1[a] + (1 - s2[a] / c1[a]) * p1(b)

    def p3(a, b, c):
        if not s3[a, b]:
            return p2(b, c)
        return max(c3[a, b, c] - d, 0) * (c3[a, b, c] >= least) / c2[a, b] + (1 - s3[a, b] / c2[a, b]) * p2(b, c)

    def score(t):
        w = [*(x.lower() for x in words(t)), "END"]
        base = sum(math.log10(p1(x)) for x in w)
        own = sum(math.log10(p1(x) if k == 0 else p2(w[k - 1], x) if k == 1 else p3(w[k - 2], w[k - 1], x)) for k, x in enumerate(w))
        return len(w), sum(c1[x] > 0 for x in w), n, base, own

    return score


@pytest.mark.parametrize("least, shards", [(1, 8), (2, 3), (3, 37)])
def test_every_least_count_and_number_of_shards(spark, monkeypatch, least, shards):
    rng = np.random.default_rng(least)
    vocabulary = [f"v{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=np.arange(60, 0, -1) / 1830)) for _ in range(60)]
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), shards, least)
    want = brute_model(texts, least)
    monkeypatch.setattr(ngram_lm, "MAPPED", 2)  # shards are dropped and opened again
    asked = [*texts[:10], "v1 new v2 v3 v1 v2", None]
    for t, *got in zip(asked, *ngram_lm.score_stream(pa.array(asked), model), strict=True):
        n, known, _, base, own = want(t)
        assert (got[0], got[1]) == (n, known) and abs(got[2] - base) < 1e-9 * max(1, -base) and abs(got[3] - own) < 1e-3 * n
    assert len(model.vocabulary.files.held) <= 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, (1 << 64) - 1), st.integers(1, 1 << 34), max_size=20))
def test_blocks_keep_large_counts(counts):
    keys = np.array(sorted(counts), np.uint64)
    raw = ngram_lm.pack_block(keys, np.array([counts[k] for k in keys.tolist()], np.int64))
    got, n = ngram_lm.summed(*ngram_lm.unpack_block(raw))
    assert dict(zip(got.tolist(), n.tolist(), strict=True)) == counts


def test_language_model(spark, edges, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(30)]
    docs = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=np.arange(30, 0, -1) / 465))) for k in range(80)] + [(100, "V1 v2 v3 unseen v1 v2"), (101, None), (102, "nothing known")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = ngram_lm.train(df.where("doc_id < 80"))
    want = brute_model([t for i, t in docs if i < 80])
    for r in ngram_lm.score(df, model).collect():
        n, known, tokens, base, own = want(dict(docs)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert abs(r.base_score - base) < 1e-9 * max(1, -base) and abs(r.score - own) < 1e-3 * n
    own = ngram_lm.train(edges)
    assert ngram_lm.score(edges, own).count() == len(EDGES)
    none = ngram_lm.train(empty)
    assert {r.base_score for r in ngram_lm.score(edges, none).collect()} == {0.0}
    assert ngram_lm.score(empty, own).count() == 0
    assert json.dumps(own.sizes)


@pytest.mark.parametrize("text, letters", [("½", False), ("①②", False), ("Ⅷ ²³ 12_", False), ("٣ 1", False), ("½ a", True), ("é", True), ("語", True), ("", False)])
def test_letters(text, letters):
    assert language_id.has_letter(text) is letters


def test_repeated_rows_stay_linear(spark):
    """Ten thousand rows of one document bring its windows once each to the row they are cut from."""
    text = " ".join(f"w{k}" for k in range(300))
    rows = spark.createDataFrame([(1, "first " + text), (3, text)], "doc_id long, text string")
    many = rows.where("doc_id = 1").union(rows.where("doc_id = 3").crossJoin(spark.range(10_000)).select("doc_id", "text")).repartition(4)
    found = substring_dedup.removable(substring_dedup._keyed(many), 50).collect()
    assert [(r.doc_id, len(r.starts)) for r in found] == [(3, 251)]
    got = substring_dedup.removed_words(many).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 0, 1), (3, 300, 10_000)}


@pytest.mark.parametrize("unit", [40, 1 << 22])
def test_a_word_that_is_half_of_all_middles(spark, monkeypatch, unit):
    """Its trigrams are dealt to many units by first word; scores stay those of the brute-force model."""
    monkeypatch.setattr(ngram_lm, "UNIT", unit)
    rng = np.random.default_rng(6)
    texts = [" ".join(w for k in range(int(rng.integers(1, 60))) for w in ("hot", f"v{rng.integers(0, 40)}")) for _ in range(50)]
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 5)
    parts = np.diff(model.units)
    assert parts.max() > 20 if unit == 40 else parts.max() == 1
    want = brute_model(texts)
    asked = [*texts[:12], "hot hot v1 hot v2 new hot", "v3", None]
    for t, *got in zip(asked, *ngram_lm.score_stream(pa.array(asked), model), strict=True):
        n, known, _, base, own = want(t)
        assert (got[0], got[1]) == (n, known) and abs(got[2] - base) < 1e-9 * max(1, -base) and abs(got[3] - own) < 1e-3 * n
