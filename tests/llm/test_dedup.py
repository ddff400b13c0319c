"""Near-dedup, components and decontamination against brute force."""
from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from vigil.llm import decontam, tokens
from vigil.llm.components import connected
from vigil.llm.near_dedup import keep_one, near_duplicates

from .conftest import words


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in sets}


def family(rng, base, n):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(1)
    texts = []
    for k in range(5):  # families whose similarities lie around the threshold
        texts += family(rng, words(60, 1000 * k), 40)
    texts += [words(40, 50000 + 100 * i) for i in range(20)] + ["Two Words", "two words", "two  words\n", "", None, " \t"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), percent=85).collect()
    want = brute(rows, 85)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_is_branched(spark, docs):
    rng = random.Random(2)
    base = words(80)
    rows = list(enumerate(family(rng, base, 120)))
    got = near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), percent=85, leaf=8, leaders=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85)


def test_large_group_hands_on_few_pairs(spark, docs, monkeypatch):
    """A group that branches and whose pairs lie around the threshold: all links, few pairs confirmed."""
    from vigil.llm import near_dedup
    asked, confirmed = [], near_dedup.confirmed

    def counting(pairs, *rest):
        asked.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirmed", counting)
    rng = random.Random(12)
    rows = list(enumerate(family(rng, words(60), 600)))
    got = near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), percent=85, leaf=128).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85)
    assert sum(asked) <= 8 * 600  # of 179700


def test_forest_spans_with_the_greatest_scores():
    from vigil.llm.near_dedup import forest
    scores = np.array([0.9, 0.8, 0.95, 0.7, 0.6])
    left, right = np.array([1, 2, 1, 5, 3]), np.array([2, 3, 3, 6, 5])
    assert forest(scores, left, right).tolist() == [2, 0, 3, 4]


def test_last_pass_hands_on_a_pair_once(spark):
    """Three alike classes meet in five nodes, two of them in a sixth: each pair comes from the least of its nodes."""
    from vigil.llm.near_dedup import binned, compare_nodes
    tiny = bytearray(binned(np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 512).tobytes())
    sketches = spark.createDataFrame([(i, tiny) for i in (1, 2, 3, 4)], "id long, tiny binary")
    rows = [(n, i, i, 0) for n in (50, 10, 40, -30, 20) for i in (1, 2, 3)] + [(n, i, i, 0) for n in (-90, 60) for i in (1, 4)]
    at = spark.createDataFrame(rows, "node long, id long, comp long, rank long")
    pairs, _ = compare_nodes(at, sketches, 2 ** 62, 16, 0.85, False)
    assert sorted((r.node, r.a, r.b) for r in pairs.collect()) == [(-90, 1, 4), (-30, 1, 2), (-30, 1, 3), (-30, 2, 3)]


def test_sketches_compare_as_row_by_row():
    """The byte sums over many bins and the skipped rows give what each pair of sketches gives alone."""
    from vigil.llm.near_dedup import Sketches, binned
    rng = np.random.default_rng(3)
    for bins, size in ((512, 40), (512, 5000), (4096, 3000)):
        pool = rng.integers(0, 2 ** 64, size, dtype=np.uint64)
        rows = np.array([binned(pool[rng.random(size) > share], bins) for share in (0, 0.02, 0.05, 0.08, 0.1, 0.14, 0.2, 0.5, 0.95)])
        held = Sketches(rows)
        for k, other in enumerate(rows):
            want = {}
            for i, own in enumerate(rows):
                x, y = own[:-4].astype(int), other[:-4].astype(int)
                n = max(int(((x > 0) | (y > 0)).sum()), 1)
                same = int(((x == y) & (x > 0)).sum())
                union = sum(float(r[-4:].copy().view(np.uint32)[0]) for r in (own, other)) / 1.85
                spread = np.sqrt(0.85 * (1 - 0.85) * n * np.clip((union - n) / max(union - 1, 1), 0, 1))
                if same >= 0.85 * n - 4.5 * spread - 1:
                    want[i] = (same + 1e-9) / n
            at, scores = held.likely(held, k, 0.85)
            assert at.tolist() == list(want) and np.allclose(scores, list(want.values()), rtol=1e-12)


def test_near_duplicates_odd_rows(spark, docs):
    a, b = words(30), words(30, 500)
    got = near_duplicates(docs([(5, a, None, None), (5, a, "en", "s"), (3, a, "en", "s"), (7, b, "en", "s"),
                                (9, b, "en", "s"), (9, a, "en", "s"), (None, a, "en", "s"), (8, "", None, None)])).collect()
    comp = sorted((r.doc_id or -1, r.component_id, r.kept) for r in got)
    assert comp == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True),
                    (9, 3, False), (9, 3, False)]
    assert near_duplicates(docs([])).collect() == []
    kept = keep_one(docs([(1, a, "en", "s"), (2, a, "en", "s"), (1, a, "en", "s"), (None, a, "en", "s"), (4, None, "en", "s")]))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4]
    assert "node" in kept.columns


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    rng.shuffle(pairs)
    got = {r.id: r.comp for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_numbers():
    texts = ["A b\tÄ", "", " x ", "a B\x0bä y", "tail"]
    data, offsets = tokens.text_bytes(pa.array([*texts, None]).slice(0, 6))
    numbers, ends = tokens.word_numbers(data, offsets)
    split = [t.encode().lower().split() for t in [*texts, ""]]
    assert np.diff(ends).tolist() == [len(w) for w in split]
    seen = {}
    for n, w in zip(numbers.tolist(), [w for ws in split for w in ws]):
        assert seen.setdefault(w, n) == n
    assert len(set(seen.values())) == len(seen)


def test_decontamination(spark, docs):
    rng = random.Random(4)
    items = [(1, words(30, 900)), (2, words(200, 3000)), (3, "three Little words"), (4, ""), (5, None), (6, words(7, 700)),
             (2, words(200, 3000))]
    long = words(5000, 10000)
    part = words(30, 900).split()
    part[3] = "other"  # 4 of 26 shingles lost: still above 0.8
    rows = [(1, long + " " + items[0][1] + " " + long, "en", "s"), (2, "x " + " ".join(part) + " y", "en", "s"),
            (3, words(30, 900)[: 20], "en", "s"), (4, "say THREE little words now", "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"),
            (None, items[0][1], "en", "s"), (8, items[1][1], "en", "s"), (8, items[1][1], "en", "s"), (9, long, "en", "s")]
    rng.shuffle(rows)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h", "2 as doc_id")
    got = decontam.contained_items(docs(rows), bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 1), (1, 1), (2, 1), (4, 3), (8, 2)]
    left = decontam.decontaminate(docs(rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 9]
    assert decontam.decontaminate(docs(rows), bench.limit(0)).count() == len(rows)
    assert decontam.contained_items(docs([]), bench).collect() == []


def test_decontamination_null_and_clashing_items(spark, docs):
    """An item without an id is found, and each text of a repeated id on its own."""
    bench = spark.createDataFrame([(None, words(30, 900)), (None, words(40, 2000)), (7, words(30, 4000)), (7, words(60, 5000))],
                                  "item_id long, text string")
    rows = [(1, "x " + words(30, 900), "en", "s"), (2, words(30, 4000) + " y", "en", "s"), (3, words(50, 8000), "en", "s"),
            (4, words(40, 2000), "en", "s")]
    got = decontam.contained_items(docs(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.item_shingles) for r in got) == [(1, None, 26), (2, 7, 26), (4, None, 36)]
    assert [r.doc_id for r in decontam.decontaminate(docs(rows), bench).collect()] == [3]


def test_hits_needed():
    for size in (17, 40, 64, 200, 1000):
        sample = decontam.sample_size(1 << (size - 1).bit_length())
        need = decontam.hits_needed(size, sample, 80)
        rng, low = np.random.default_rng(0), 10 ** 9
        inside = -(-80 * size // 100)
        for _ in range(2000):
            low = min(low, (rng.permutation(size)[:sample] < inside).sum())
        assert 1 <= need <= low
