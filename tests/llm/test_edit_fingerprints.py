"""Edit fingerprints against the walk spelled out, the order of documents in plain Python, and all pairs."""

import hashlib
import random

import numpy as np
import pytest

from fellwalk.llm import edit_fingerprints as edit

SCHEMA = "doc_id long, text string, part string, sub long, guest boolean"
RNG = random.Random(5)
PROSE = " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(2, 9))) for _ in range(900))


def plain_walk(text):
    """What the pointer writes, step by step, by the bits themselves."""
    bits = np.random.default_rng(edit.SEED).integers(0, 2, (edit.CLASSES, edit.PERIOD), dtype=np.uint8)
    classes = edit._characters()[0]
    out, at, step = [], 0, 0
    while at < len(text):
        out.append(text[at])
        at += int(bits[classes[ord(text[at])], step % edit.PERIOD])
        step += 1
    return out


@pytest.mark.parametrize("text", ["a", "ab", "éa😀", "aaaaaaaaaaaaaaaa", PROSE[:700], "\x00\n"])
def test_walk(text):
    written = plain_walk(text)
    left = edit.walk(edit.code_points(text))
    assert left[-1] == len(written)
    assert "".join(text[i] for i in np.searchsorted(left, np.arange(left[-1]), "right")) == "".join(written)
    fp = edit.fingerprint(text)
    symbols = edit._characters()[1]
    steps = [int(s) for k in range(len(fp) // edit.SAMPLES) for s in edit._steps(k)]
    assert fp == "".join(chr(symbols[ord(written[s])]) if s < len(written) else edit.END for s in steps)
    assert len(steps) >= len(written) > len(steps) - edit.SAMPLES - 1 or edit.SAMPLES * ((1 << len(steps) // edit.SAMPLES) - 1) >= len(written)


def test_walk_goes_on_where_it_stopped():
    points = edit.code_points(PROSE)
    whole = edit.walk(points)
    assert (np.concatenate((whole[:100], edit.walk(points[100:], int(whole[99])))) == whole).all()


def test_likeness():
    assert edit.likeness("", "") == edit.likeness(edit.fingerprint("x"), edit.fingerprint("x")) == 1
    assert edit.likeness("", edit.fingerprint("abc")) == edit.likeness(edit.fingerprint("abc"), "") == 0
    other = PROSE[::-1]
    near = [edit.likeness(edit.fingerprint(PROSE), edit.fingerprint(PROSE[:n] + "Q" + PROSE[n:])) for n in (0, 1000, 3000)]
    assert min(near) > 0.85 and edit.likeness(edit.fingerprint(PROSE), edit.fingerprint(other)) < 0.25
    # the estimate is near the share over all steps
    edited = PROSE[: len(PROSE) * 2 // 3] + other[: len(PROSE) // 3]
    a, b = plain_walk(PROSE), plain_walk(edited)
    exact = sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))
    assert abs(edit.likeness(edit.fingerprint(PROSE), edit.fingerprint(edited)) - exact) < 0.08


def in_order(rows):
    import xxhash

    hashed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  as signed numbers
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1] or ""), r[1] or ""))


@pytest.mark.parametrize("copies", [0, 400])
def test_edited_texts(spark, copies):
    texts = [PROSE[i : i + RNG.randint(0, 90)] for i in range(150)] + [None, "", "x", "né", PROSE, "long " * 40_000]
    rows = [(RNG.choice([k, k, -k, (1 << 62) + k, None]), t) for k, t in enumerate(texts)] + [(7, f"one id {k}") for k in range(copies)] + [(7, "repeated")] * 3
    RNG.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 0, None) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r)[:7] for r in edit.fingerprints(docs).collect()), key=str)
    order, want = in_order(rows), []
    for (k, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        m = len(t) // 3
        changed = t[: len(t) - m] + following[:m]
        f, g, h = (edit.fingerprint(x) for x in (t, changed, following))
        want.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), f, g, edit.likeness(f, g), edit.likeness(f, h)))
    assert got == sorted(want, key=str)


def test_few_rows(spark):
    assert edit.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = edit.fingerprints(spark.createDataFrame([(1, "abcdef", "", 0, None)], SCHEMA)).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1


def test_near_copies(spark):
    groups = [PROSE[500 * k : 500 * k + 480] for k in range(6)]
    texts = [*groups, *(t[:n] + "#" + t[n + 1 :] for t in groups for n in range(3, 480, 60)), None, "", "", "ab", "ab", *(f"{k} {PROSE[k * 31 :: 7][:200]}" for k in range(20))]
    docs = spark.createDataFrame([(100 - k, t, "", 0, None) for k, t in enumerate(texts)] + [(None, "ab", "", 0, None), (None, "alone", "", 0, None)], SCHEMA).repartition(3)
    old, edit.BLOCK = edit.BLOCK, 5
    try:
        got = edit.near_copies(docs).collect()
    finally:
        edit.BLOCK = old
    fps = {100 - k: edit.fingerprint(t) for k, t in enumerate(texts)}
    least = {k: k for k in fps}
    for _ in fps:
        for a, f in fps.items():
            for b, g in fps.items():
                if edit.likeness(f, g) >= edit.SIMILAR:
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[least[k]] == least[k] for k in least):
            break
    by_fp = {fps[k]: v for k, v in least.items()}
    assert len(got) == docs.count()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(least.items())
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id is None} == {(edit.fingerprint("ab"), by_fp[edit.fingerprint("ab")]), (edit.fingerprint("alone"), None)}
    assert edit.near_copies(docs.limit(0)).count() == 0


def test_bands_find_near_copies():
    """Simulated texts of even edits: of pairs at a likeness of 0.8 or more, about MISSED at most are in no band."""
    rng = np.random.default_rng(4)
    for n in (1 << 10, 1 << 20, 1 << 34):
        width, bands = edit.band_plan(n)
        missed = 0
        for _ in range(400):
            a = rng.choice(edit.SYMBOLS, 2 * edit.SAMPLES)
            b = np.where(rng.random(len(a)) < 0.2, rng.choice(edit.SYMBOLS, len(a)), a)
            x, y = (edit.band_keys(bytes(s).decode(), width, bands) for s in (a, b))
            missed += not np.isin(x, y).any()
        assert missed <= 6 and n * bands * edit.STRETCHES * edit.CHANCE**width <= 0.01
