import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fellwalk.llm import embedding_dedup, mixing, simhash
from fellwalk.llm.graph import Forest, Union, components

SCHEMA = "doc_id long, text string, source string, lang string, component string"


def words(t):
    return (t or "").encode().split()


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_sets(pairs):
    want = brute_components(range(31), pairs)
    u = Union(31)
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    u.join(a, b)
    assert u.flat().tolist() == [want[i] for i in range(31)]
    forest = Forest(most=3)
    for x, y in pairs:
        forest.add(np.array([x * 10]), np.array([y * 10]))
    own, root = forest.edges()
    assert {i: r for i, r in zip(own.tolist(), root.tolist(), strict=True)} == {10 * i: 10 * r for i, r in want.items() if i != r}


def test_components_of_paths_stars_and_rings(spark):
    rng = np.random.default_rng(0)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(300 + k, 300 + (k + 7) % 40) for k in range(40)] + [(int(a), int(b)) for a, b in rng.integers(400, 700, (200, 2))] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    ids = {i for p in pairs for i in p if p[0] != p[1]}
    assert got == {i: c for i, c in brute_components(ids, [p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def brute_fingerprint(t, k=4):
    w = words((t or "").encode().lower().decode())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "C,", "é", "zz"]), max_size=12))
def test_fingerprint(ws):
    assert simhash.fingerprint(" ".join(ws)) == brute_fingerprint(" ".join(ws))


@pytest.mark.parametrize("block", [4096, 5])
def test_links_within_the_distance(spark, monkeypatch, block):
    """Also with buckets so small that they are cut into a grid of blocks."""
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist()) | {0, 1, 3}
    for _ in range(400):  # clouds around a few, and two hot parts
        f = int(base[rng.integers(0, 6)])
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps |= {(int(base[0]) & ~0xFFFF) | int(x) for x in rng.integers(0, 1 << 16, 40)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "id long, fp0 long").select("fp0", "id")
    for distance in (0, 2, 4):
        want = brute_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance])
        # the functions that run in workers are pickled by reference, so the block size travels as a module value
        got = {r.node: r.component for r in components(_links_local(df, fps, distance, spark)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def _links_local(df, fps, distance, spark):
    """The search of simhash.links() in this process, so that the patched block size holds."""
    import pandas as pd

    fp = np.array(fps, np.uint64).reshape(-1, 1)
    bits = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    counts = [np.bincount(simhash.part_values(fp, b), minlength=1 << 16) for b in bits]
    index = simhash.Index(bits, counts, distance + 1)
    parts = [(b, r, k) for b, k, r in index.posts(fp) if len(r)]
    bucket, row, kind = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(bucket, kind="stable")
    forest = Forest()
    simhash.verified(bucket[order], fp[row[order]], row[order].astype(np.int64), kind[order].astype(np.int8), distance, forest, step=500)
    a, b = forest.edges()
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b}), "a long, b long")


def test_thresholds_always_cover_the_distance():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, (300, 1), dtype=np.uint64)
    bits = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    values = [simhash.part_values(fp, b) for b in bits]
    counts = [np.bincount(v, minlength=1 << 16) + 3 * (np.arange(1 << 16) < 40_000) * (k == 1) for k, v in enumerate(values)]
    t = simhash.Index(bits, counts, 5).thresholds(values)
    assert (t.sum(0) == 4 - 4 + 1).all() and t.min() >= -1
    index = simhash.Index(bits, counts, 5)

    def cost(alloc, i):
        probes = (1, 17, 137)
        return sum(0 if a < 0 else index.near[k][a][values[k][i]] + simhash.PROBE_COST * (probes[a] - 1) for k, a in enumerate(alloc))

    from itertools import product

    for i in range(20):
        best = min(cost(a, i) for a in product((-1, 0, 1, 2), repeat=4) if sum(a) == 1)
        assert math.isclose(cost(t[:, i], i), best)


def test_simhash_documents(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, n))
    a, b, long = text(300), text(200), text(20_000)
    docs = [(10, a), (11, a), (4, a + " tail"), (20, b), (21, b.replace("w", "W")), (30, None), (31, ""), (32, " \n"), (40, long), (41, long), (50, "two words"), (None, a), (60, text(80)), (60, text(80)), (70, text(5))]
    df = spark.createDataFrame([(i, t, "s", None, "x") for i, t in docs], SCHEMA)
    rows = simhash.clusters(df).collect()
    assert len(rows) == len(docs)
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    assert Counter((r.doc_id, r.fp0 % (1 << 64)) for r in rows) == Counter(fps)
    known = [(i, f) for i, f in fps if i is not None]
    least = {}
    for i, f in known:
        least[f] = min(i, least.get(f, i))
    ids = sorted(least.values())
    linked = [(least[x], least[y]) for x in least for y in least if x < y and (x ^ y).bit_count() <= 4]
    want = brute_components(ids, linked)
    assert all(r.component_id == want[least[r.fp0 % (1 << 64)]] for r in rows if r.fp0 % (1 << 64) in least)
    assert simhash.clusters(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} >= {4, 20, 30, 40, 50, 60, 70, None} and not {10, 11, 21, 31, 41} & {r.doc_id for r in kept.collect()}
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_similar_texts_are_found(spark):
    rng = np.random.default_rng(9)
    docs = []
    for k in range(60):
        w = [f"w{int(x)}" for x in rng.integers(0, 5000, 300)]
        docs.append((2 * k, " ".join(w)))
        for at in rng.choice(300, 3, replace=False):  # about 15 of 296 shingles change: 0.9
            w[at] = "changed"
        docs.append((2 * k + 1, " ".join(w)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert {2 * k for k in range(60)} <= kept and len(kept) <= 68


@pytest.mark.parametrize("shared, tail, least, most", [(240, 40, 0, 0), (239, 30, 0, 0), (240, 30, 0.97, 1), (340, 30, 1, 1)])
def test_links_are_the_pairs_at_the_similarity(spark, shared, tail, least, most):
    """Isolated pairs with a Jaccard similarity of 0.75, just below 0.8, 0.8 and 0.85."""
    rng = np.random.default_rng(shared + tail)
    docs = []
    for k in range(300):
        w = [f"w{int(x)}" for x in rng.integers(0, 1 << 30, shared + 4 + 2 * tail)]
        docs += [(2 * k, " ".join(w[: shared + 4 + tail])), (2 * k + 1, " ".join(w[: shared + 4] + w[shared + 4 + tail :]))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)).collect()}
    assert {2 * k for k in range(300)} <= kept
    assert least <= (600 - len(kept)) / 300 <= most


def test_similar_texts_of_a_large_group(spark, monkeypatch):
    """A chain of copies, in blocks and in one: components equal those of all pairs."""
    rng = np.random.default_rng(12)
    base, docs = [f"w{int(x)}" for x in rng.integers(0, 1 << 30, 204)], []
    for k in range(90):
        w = list(base)
        for at in rng.choice(204, rng.integers(0, 12), replace=False):
            w[at] = f"new{k}-{at}"
        docs.append((k, " ".join(w)))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in docs]
    want = brute_components(range(90), [(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert 1 < len(set(want.values())) < 90
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    groups = spark.createDataFrame([(k, 0) for k in range(90)], "node long, component long")
    for texts in (1024, 20):
        monkeypatch.setattr(simhash, "TEXTS", texts)
        got = {r.node: r.component for r in components(simhash.similar(df, groups, 0.8, 5, 256)).collect()}
        assert {i: got.get(i, i) for i in range(90)} == want


# --- embeddings


def test_e8_is_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)) * 2
    p = embedding_dedup.nearest_e8(x)
    assert (np.mod(2 * p, 1) == 0).all() and (np.mod(p.sum(1), 2) == 0).all() and (np.mod(p, 1) == np.mod(p[:, :1], 1)).all()
    around = p[:, None] + embedding_dedup.ROOTS[None]  # no neighbour is closer
    assert (((x[:, None] - around) ** 2).sum(2).min(1) >= ((x - p) ** 2).sum(1) - 1e-9).all()
    assert len({tuple(r) for r in embedding_dedup.ROOTS.tolist()}) == 240 and np.allclose((embedding_dedup.ROOTS**2).sum(1), 2)


@pytest.mark.parametrize("most", [2048, 4])
def test_embeddings(spark, most):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        v = rng.standard_normal(32)
        for _ in range(1 + k % 4):
            rows.append((v + 0.12 * rng.standard_normal(32)).astype(np.float32).tolist())
    hot = rng.standard_normal(32)
    rows += [(hot + 0.05 * rng.standard_normal(32)).astype(np.float32).tolist() for _ in range(25)] + [rows[3]] * 3 + [[2 * x for x in rows[5]]]
    rows += [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0], [1e30] * 32, [1e-30] * 32]
    data = [(7 * k % 1009, r, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links int")
    x = {i: np.array(np.array(r, np.float32), float) for i, r, _ in data if r and None not in r and np.isfinite(r).all() and any(r)}
    cos = lambda a, b: len(a) == len(b) and (a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max())
    linked = [(i, j) for i in x for j in x if i < j and cos(x[i], x[j]) >= 0.95]
    n = Counter(i for p in linked for i in p)
    want = brute_components([i for i, _, _ in data], linked)
    if most == 2048:
        got = embedding_dedup.near_duplicates(df).collect()
        assert len(got) == len(data)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], r.vec_id == want[r.vec_id])
        assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    else:  # cells larger than a block are compared block by block
        keyed = embedding_dedup._keyed(df, "vec_id", "embedding").where("key is not null")
        classes = keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v"), F.first("kind").alias("kind"))
        found = embedding_dedup.links(classes, 2, embedding_dedup.TABLES, 0.95, most).collect()
        size = {r.id: r.w for r in classes.collect()}
        others = Counter()
        for r in found:
            if r.b is None:
                others[r.a] += r.n
        assert all(others[i] + size[i] - 1 == n[i] for i in size)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal((400, 64))
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * z
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate((a, b)))], "vec_id long, embedding array<double>")
    assert sum(r.n_links for r in embedding_dedup.near_duplicates(df).collect()) / 800 >= 0.95


@pytest.mark.parametrize("length", [8, 16, 32, 64])
def test_recall_of_vectors_of_any_length(length):
    rng = np.random.default_rng(length)
    a = embedding_dedup.unit_rows(rng.standard_normal((4000, length)))
    z = rng.standard_normal((4000, length))
    z = embedding_dedup.unit_rows(z - (z * a).sum(1, keepdims=True) * a)
    lattice = embedding_dedup.Lattice(length, embedding_dedup.BLOCKS)
    x, y = lattice.cells(a), lattice.cells(0.951 * a + math.sqrt(1 - 0.951**2) * z)
    assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() >= 0.98


def test_blocks_do_not_depend_on_the_number_of_vectors(spark, monkeypatch):
    """With a table that claims two million vectors."""
    used, links = [], embedding_dedup.links
    monkeypatch.setattr(embedding_dedup, "links", lambda classes, blocks, *a: used.append(blocks) or links(classes, blocks, *a))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(type(df), "count", lambda self: 1 << 21)
    embedding_dedup.near_duplicates(df)
    assert used == [2]


# --- mixing


def brute_targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {s: 0.0 for s in order}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / total for s in free}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            return target
        for s in over:
            target[s] = 3 * size[s]
        capped |= over


def test_mixing(spark):
    rng = np.random.default_rng(6)
    docs = [(k, " ".join(["x"] * int(rng.integers(0, 90))), ["hot", "b", "c", None, "d"][min(4, int(rng.geometric(0.5)) - 1)]) for k in range(300)]
    docs += [(400, None, "b"), (401, " ", None), (402, None, "only-empty"), (403, "one", "tiny"), (5, "twice here", "b"), (5, "twice here", "b"), (None, "no id", "b"), (404, "y " * 5000, "c")]
    clashes = "taken string, size int, copies int, slots int, slot long, mix_id int, whole int, id int, words string"
    df = spark.createDataFrame([(i, t, s, "taken", 1, 2, 3, 4, 5, 6, 7, "w") for i, t, s in docs], f"doc_id long, text string, source string, {clashes}")
    rows = mixing.taken(df).collect()
    assert len(rows) == len(docs) and rows and sorted(map(str, rows)) == sorted(map(str, mixing.taken(df.repartition(7)).collect()))
    size = Counter()
    for i, t, s in docs:
        size[s] += len(words(t))
    want = brute_targets(dict(size))
    took = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12) and 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= 1 for s in size)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(words(t))) for i, t, _ in docs)
    assert mixing.taken(df.limit(0)).count() == 0
    mixed = mixing.mix_documents(df)
    assert mixed.schema == df.schema
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in rows:
        if r.doc_id not in (5, None) and r.size:
            assert abs(copies[r.doc_id] - r.taken / r.size) <= 0.5
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_every_stretch_of_the_schedule_is_mixed(spark):
    goals = spark.createDataFrame([("a", 1, 500), ("b", 2, 250), ("c", 3, 250)], "source string, source_id long, take long")
    slots = sorted(mixing.schedule(mixing.runs_of(goals, 8), 8).collect(), key=lambda r: r.slot)
    assert [r.slot for r in slots] == list(range(256))
    for i in range(0, 256, 16):
        n = Counter(r.source_id for r in slots[i : i + 16])
        assert (n[1], n[2], n[3]) == (8, 4, 4)
    for s in (1, 2, 3):
        assert [r.k for r in slots if r.source_id == s] == list(range(sum(r.source_id == s for r in slots)))
    plan = mixing.taken(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixed_documents_follow_the_schedule(spark):
    rows = [(400 * k + i, " ".join(["x"] * 10), s) for k, s in enumerate("abc") for i in range(400)]
    mixed = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(mixed) == 1200 and max(Counter(r.doc_id for r in mixed).values()) == 2
    for i in range(0, 1200, 120):  # weights 1, 2, 3
        n = Counter(r.source for r in mixed[i : i + 120])
        assert abs(n["a"] - 20) <= 4 and abs(n["b"] - 40) <= 4 and abs(n["c"] - 60) <= 4
    at = {}
    for i, r in enumerate(mixed):
        assert i - at.get(r.doc_id, -1200) >= 120  # another lap
        at[r.doc_id] = i


def test_copies_of_one_slot_have_an_order(spark):
    docs = [(k, f"text {k} of a few words", "one", "", "") for k in range(200)]
    mixed = [[r.doc_id for r in mixing.mix_documents(spark.createDataFrame(docs, SCHEMA).repartition(n)).collect()] for n in (1, 7)]
    assert mixed[0] == mixed[1]
