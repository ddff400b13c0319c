"""Periodic run detection: the maximal repetitions in the words of a text.

A run is a stretch of words with smallest period q that no neighbouring word extends,
of at least `least` and 2 q words; a word is dropped from the collapsed text if it lies
behind the first q words of any run.

Method.  The suffixes of a text are sorted by prefix doubling and neighbours get their
longest common prefix (LCP).  By descending LCP, as in Kruskal's tree, the classes of
suffixes are united by union-find, each with its positions in order.  When two classes
unite at LCP l, positions i < j that become neighbours at a distance d <= l are a seed:
the words from i to j + l have the smallest period d and end there.  Seeds of one (d, end)
are one run, which the least i starts.  A run of `least` words with period at most half of
it has an LCP of at least half of `least`, so edges below that are never needed.

Texts are worked on in blocks of whole texts with about `BLOCK_WORDS` words (a longer text
is a block of its own); all words of a text are used.  Rows are independent, so nothing is
shuffled.

Defined results: a null or empty text and one without words has no words, no runs and an
empty collapsed text; rows count each, equal or not, whatever their id; other columns are
left out.  Words are compared byte by byte, in their case.
"""
from __future__ import annotations

from bisect import bisect, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

BLOCK_WORDS = 1 << 18


def suffix_order(start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, classes by their first 1, 2, 4, ... symbols) of an integer sequence.

    Every class but the last level's is a number that suffixes with equal first symbols share;
    only suffixes that are not alone in their class are sorted again.  The last symbol must be
    the only one of its kind.
    """
    n = len(start)
    order = np.argsort(start, kind="stable")
    ranked = start[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, k = [rank], 1
    while True:
        tied = np.zeros(n, bool)
        sizes = np.diff(np.r_[first, n])
        tied[:] = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        if not len(at):
            return order, levels
        who = order[at]
        key = rank[who] * n + rank[np.minimum(who + k, n - 1)]
        by = np.argsort(key, kind="stable")
        order[at] = who[by]
        key = key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[order[at]] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        levels.append(rank)
        ranked = rank[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order whose suffix shares `least` symbols or more with the one before, and how many."""
    base = levels[min(len(levels) - 1, least.bit_length() - 1)]
    at = np.flatnonzero(base[order[1:]] == base[order[:-1]]) + 1
    i, j = order[at - 1].copy(), order[at].copy()
    shared = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        equal = levels[level][i] == levels[level][j]
        step = equal.astype(np.int64) << level
        shared += step
        i += step
        j += step
    kept = shared >= least
    return at[kept], shared[kept]


def seeds(positions: list[int], shared: list[int]) -> dict[tuple[int, int], int]:
    """(period, end) to the least start of the seeds of one class of suffixes in order.

    `shared[k]` is the LCP of positions k and k + 1.
    """
    parent = list(range(len(positions)))
    members = [[p] for p in positions]
    found: dict[tuple[int, int], int] = {}

    def seed(i, j, lcp):
        if j - i <= lcp:
            run = (j - i, j + lcp)
            if i < found.get(run, i + 1):
                found[run] = i

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in sorted(range(len(shared)), key=shared.__getitem__, reverse=True):
        lcp, a, b = shared[k], root(k), root(k + 1)
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        gap, before = -1, 0
        for x in small:
            here = bisect(large, x)
            if here != gap:
                if 0 <= gap < len(large):
                    seed(before, large[gap], lcp)
                if here:
                    seed(large[here - 1], x, lcp)
                gap = here
            before = x
        if gap < len(large):
            seed(before, large[gap], lcp)
        if len(small) < 8:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        parent[b] = a
        members[b] = []
    return found


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as words, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.r_[0, sizes + 1])  # every text ends with a symbol of its own
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    symbols = np.empty(int(starts[-1]), np.int64)
    for t, s in zip(texts, starts.tolist()):
        symbols[s:s + len(t)] = [number(w, len(numbers)) for w in t]
    ends = starts[1:] - 1
    symbols[ends] = len(numbers)
    symbols += np.repeat(np.arange(len(texts)), sizes + 1) * (len(numbers) + 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(symbols):
        return out
    order, levels = suffix_order(symbols)
    at, shared = common_prefixes(order, levels, (least + 1) // 2)
    if not len(at):
        return out
    begin = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # classes: stretches of the order
    close = np.r_[begin[1:], len(at)]
    # A class whose nearest positions lie further apart than its greatest LCP has no seed.
    members = np.concatenate([at, at[begin] - 1])
    which = np.concatenate([np.repeat(np.arange(len(begin)), close - begin), np.arange(len(begin))])
    places = order[members]
    by = np.lexsort((places, which))
    which, places = which[by], places[by]
    gaps = np.where(which[1:] == which[:-1], places[1:] - places[:-1], len(symbols))
    nearest = np.full(len(begin), len(symbols))
    np.minimum.at(nearest, which[1:], gaps)
    greatest = np.maximum.reduceat(shared, begin)
    found: dict[tuple[int, int], int] = {}
    for c in np.flatnonzero(nearest <= greatest).tolist():
        a, z = begin[c], close[c]
        span = order[at[a] - 1:at[z - 1] + 1].tolist()
        for run, i in seeds(span, shared[a:z].tolist()).items():
            if i < found.get(run, i + 1):
                found[run] = i
    for (period, end), i in found.items():
        if end - i >= least:
            t = int(np.searchsorted(starts, i, "right")) - 1
            out[t].append((i - int(starts[t]), end - i, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that lie behind the first period of no run."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and the collapsed text of every row."""
    names = ["doc_id", "n_words", "runs", "collapsed"]
    kind = dict(docs.dtypes)["doc_id"]

    def blocks(texts):
        held, size = [], 0
        for t in texts:
            words = (t or b"").split()  # for bytes: at runs of \x20 and \x09-\x0D
            if held and size + len(words) > BLOCK_WORDS:
                yield held
                held, size = [], 0
            held.append(words)
            size += len(words)
        if held:
            yield held

    def run(batches):
        for b in batches:
            at = 0
            for texts in blocks(x.as_py() for x in b.column("text").cast(pa.binary())):
                found = runs_of(texts, least)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], pa.list_(RUN)),
                     pa.array([b" ".join(kept_words(t, f)) for t, f in zip(texts, found)], pa.binary()).cast(pa.string())],
                    names)
                at += len(texts)

    return text_batches(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; with crc32(doc_id) % 10 = 0, the words from some place on repeat with some period.

    With g = crc32 div 10 and n words, that place is a = g % n and the period 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    again = f"""transform(array({words}), w -> transform(array(cast(_h div 10 % size(w) as int)), a ->
        transform(array(cast(1 + (size(w) - a) div (3 + _h div 10 % 8) as int)), p ->
            array_join(transform(sequence(0, size(w) - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' '))[0])[0])[0]"""
    return docs.select("doc_id", "text", h.alias("_h")).select(
        "doc_id", F.expr(rf"case when _h % 10 = 0 and text rlike '[^\\x20\\x09-\\x0D]' then {again} else text end").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number, longest run and SHA-256 of the runs and the collapsed text of each row."""
    longest = "array_min(transform(runs, x -> struct(-x.length as l, x.start as s, x.period as p)))"
    return found.withColumn("_top", F.expr(longest)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.s").alias("start"),
        (-F.col("_top.l")).alias("length"), F.col("_top.p").alias("period"),
        F.expr("1000 * -_top.l div _top.p").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
