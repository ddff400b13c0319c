"""Conversation repair, periodic runs and packing against brute force."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.llm import packing, repair, runs
from vigil.llm.queries import word_bpe

from .conftest import SF, needs_tables

GRAMMAR = {0: "su", 1: "u", 2: "a", 3: "u"}  # letters that may follow: at the start, behind s, u, a


# ------------------------------------------------------------------ conversation repair

def cheapest(codes):
    """(cost, audit) by trying all edits, state by state."""
    best = {0: (0, "")}

    def offer(to, q, found):
        if q not in to or found < to[q]:
            to[q] = found

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for p, (cost, audit) in list(ways.items()):
                offer(ways, 3 if p == 2 else 2, (cost + 3, audit + "I"))
        return ways

    for code in codes:
        after: dict = {}
        for p, (cost, audit) in inserted(best).items():
            offer(after, p, (cost + 4, audit + "D"))
            for letter in GRAMMAR[p] if code != "x" else "":
                q = {"s": 1, "u": 2, "a": 3}[letter]
                extra = 3 if code.isupper() else 0
                if code.lower() == letter:
                    offer(after, q, (cost + extra, audit + "K"))
                elif letter != "s":
                    offer(after, q, (cost + extra + 3, audit + "R"))
        best = after
    return min(found for q, found in inserted(best).items() if q in (0, 3))


def in_turn_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def faults(rows):
    seen, codes, counts = set(), "", Counter()
    for _, role, text in rows:
        trimmed = text.rstrip(repair.SPACE)
        fault = ("blank" if not trimmed else "duplicate" if (role, text) in seen
                 else "truncated" if trimmed[-1] not in ".!?" else None)
        seen.add((role, text))
        counts[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    return codes, counts


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns) of (turn, role, text) rows."""
    rows = in_turn_order(rows)
    codes, counts = faults(rows)
    cost, audit = cheapest(codes)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    left = [c for c in audit if c != "D"]
    names = (["system"] if len(left) % 2 else []) + ["user", "assistant"] * (len(left) // 2)
    out, todo = [], iter(rows)
    for c in audit:
        row = next(todo) if c != "I" else None
        if c != "D":
            name = names[len(out)]
            out.append((row[1], row[2]) if c == "K" else (name, row[2] if row else ""))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, out)


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_segments_join_to_the_cheapest_audit():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice("suaoSUAOxuauaua") for _ in range(rng.randint(1, 12)))
        cuts = sorted(rng.sample(range(1, len(codes)), rng.randint(0, len(codes) - 1))) if len(codes) > 1 else []
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        ways = repair.joined([dict(zip("pq", w[:2]), cost=w[2], audit=w[3]) for w in repair.aligned(p)] for p in parts)
        assert min((w["cost"], w["audit"]) for w in ways if w["p"] == 0 and w["q"] in (0, 3)) == cheapest(codes)


def test_repair(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 4)
    monkeypatch.setattr(repair, "FAN_IN", 3)
    rng = random.Random(8)
    texts = ["Yes.", "No!", "cut off", "", "  \t", "Why?", "Yes.  ", "a\nb.", "x" * 20000, " ", "."]
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    convs = {c: [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
             for c, n in {1: 3, 2: 7, 3: 1, 4: 90, None: 60, 6: 40}.items()}
    convs[7] = [(t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(200)]
    convs[8] = [(None, " ", " ")] * 3
    convs[9] = [(4, "user", "Same.")] * 30
    rows = [(c, *r) for c, found in convs.items() for r in found]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, part string, at int")
    got = {r.conv_id: r for r in repair.repair(df).collect()}
    assert len(got) == len(convs)
    for c, found in convs.items():
        want = brute_repair(found)
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:-1], c
        assert r.repaired_sha256 == digest(want[-1])
    turns: dict = {}
    for r in repair.repaired(df, repair.audits(df)).orderBy("conv_id", "position").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, found in convs.items():
        assert turns.get(c, []) == brute_repair(found)[-1]


def test_repair_after_damage(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(9)]), rng.choice([None, "user", "assistant", "system"]),
             rng.choice([None, "", "Well. Yes!", "so", "Then what?", "Good.\n"])) for _ in range(250)]
    rows += [(c, 0, "user", "Alone.") for c in range(100, 160)]  # some of these lose their only turn
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.repair_all(df, repair.damaged(df)).collect()}
    convs: dict = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else text.translate(str.maketrans("", "", ".!?")) if code == 2 else text
            own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    assert set(got) == set(convs) and any(not own for own in convs.values())
    for conv, own in convs.items():
        want = brute_repair(own)
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:-1]
        assert r.repaired_sha256 == digest(want[-1])


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_all(df, repair.damaged(df)).collect() == []
    assert repair.repaired(df, repair.audits(df)).collect() == []


# ------------------------------------------------------------------ periodic runs

def brute_runs(words, least):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            run = words[i:j + q]
            if len(run) >= max(least, 2 * q) and not any(
                    all(run[k] == run[k + p] for k in range(len(run) - p)) for p in range(1, q)):
                out.append((i, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words: list = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.randint(0, 2)
        if kind == 0:
            words += [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        elif kind == 1:
            words += [rng.choice("abc") for _ in range(rng.randint(1, 9))] * rng.randint(1, 5)
        else:
            words += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 20))]
    return words


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_of(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        assert runs.runs_of([[w.encode() for w in t] for t in texts], least) == [brute_runs(t, least) for t in texts]


def test_periodic_runs(spark, docs, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_WORDS", 50)
    rng = random.Random(4)
    texts = [" ".join(repetitive(rng)) for _ in range(120)]
    texts += [None, "", " \t ", "a " * 30000, "A a " * 9, "x x " * 8, "x\ny\x0b" * 9, texts[0], texts[0]]
    df = docs([(None if i == 5 else i // 2, t, "en", "s") for i, t in enumerate(texts)])
    got = runs.digests(runs.periodic_runs(runs.made_periodic(df))).collect()
    want = Counter()
    for i, t in enumerate(texts):
        doc_id = None if i == 5 else i // 2
        words = (t or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute_runs(words, 12) if len(words) < 20000 else [(0, len(words), 1)]
        dropped = {k for s, n, q in found for k in range(s + q, s + n)}
        top = min(((-n, s, q) for s, n, q in found), default=None)
        want[(doc_id, len(found), *((top[1], -top[0], top[2], -1000 * top[0] // top[2]) if top else (None,) * 4),
              hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
              hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert runs.digests(runs.periodic_runs(runs.made_periodic(docs([])))).collect() == []


# ------------------------------------------------------------------ packing

def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                b = rooms.index(room)
                put(i + 1, rooms[:b] + [room - items[i]] + rooms[b + 1:])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best[0]


def test_pack_lengths_is_optimal_on_small_inputs():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, rng.choice([capacity, capacity // 2])) for _ in range(rng.randint(0, 10))]
        counts = Counter(items)
        fillings = packing.pack_lengths(dict(counts), capacity)
        held = Counter()
        for times, lengths in fillings:
            assert sum(lengths) <= capacity
            for s in lengths:
                held[s] += times
        assert held == counts
        bins = sum(times for times, _ in fillings)
        assert packing.lower_bound(dict(counts), capacity) <= bins == fewest(items, capacity)


def test_pack_lengths_reaches_the_bound_on_many_documents():
    rng = random.Random(6)
    counts = Counter(min(4096, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(20000))
    fillings = packing.pack_lengths(dict(counts))
    assert sum(t for t, _ in fillings) == packing.lower_bound(dict(counts), 4096)
    assert fillings == packing.pack_lengths(dict(counts))


def whole_tokens(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe())
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


ODD = ["a", "B", "É", "é", "́", "ß", "İ", "Σ", "ς", " ", "\t", "\n", " ", " ", "\x1c", "\x85", "\x0b", "'s",
       "'LL", "1", "23", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "日", "👍", "‍", "ﬁ", "̸", "=", ".", ",", "ª", "Ⅷ"]


def test_pieces_are_those_of_whole_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20000)
    rng = random.Random(7)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "  ", "word " * 9000, "The end, " * 2047, "The end, " * 2048, texts[0], texts[0]]
    df = docs([(None if i == 9 else i, t, "en", "s") for i, t in enumerate(texts)])
    got: dict = {}
    for r in packing.pieces(df, word_bpe).collect():
        ids = [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert len(ids) == r.length <= 4096 and r.start == 4096 * r.piece
        got.setdefault(r.doc_id, {})[r.piece] = ids
    for i, want in enumerate(whole_tokens(texts)):
        own = got[None if i == 9 else i]
        assert [x for p in sorted(own) for x in own[p]] == want
        assert len(own) == -(-len(want) // 4096)


def gapless(rows, capacity):
    """Number of sequences, each without gaps or overlaps."""
    held: dict = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 1, rng.randint(1, 40), 64, rng.randint(20, 64)]), "x") for i in range(3000)] + [(5, 7, "y")] * 200
    df = spark.createDataFrame(rows, "doc_id long, length long, sequence_ string")
    got = packing.pack(df, ["doc_id"], capacity=64).collect()
    assert Counter((r.doc_id, r.length, r.sequence_) for r in got) == Counter(rows)
    counts = Counter(n for _, n, _ in rows)
    assert gapless(got, 64) == packing.lower_bound(dict(counts), 64)
    again = packing.pack(df.repartition(5), ["doc_id"], capacity=64).collect()
    place = lambda r: (r.doc_id, r.length, r.sequence_id, r.offset)
    assert Counter(map(place, again)) == Counter(map(place, got))
    assert packing.pack(df.limit(0), ["doc_id"], capacity=64).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, ["doc_id"], capacity=32)


@needs_tables
def test_sequences_hold_all_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(packing.pieces(docs, word_bpe), ["doc_id", "piece"])
    made = packing.sequences(packed).agg(F.sum("length"), F.sum(F.length("ids")), F.count("*"), F.max("length")).first()
    texts = [r.text for r in docs.select("text").collect()]
    lengths = [len(t) for t in whole_tokens(texts)]
    assert made[0] == sum(lengths) and made[1] == 4 * sum(lengths) and made[3] <= 4096
    cut = Counter(x for n in lengths for x in [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0))
    assert made[2] == packing.lower_bound(dict(cut), 4096) == gapless(packed.collect(), 4096)
