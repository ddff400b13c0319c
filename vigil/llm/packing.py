"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one end id; only documents longer than a sequence are cut,
into whole sequences and a last piece.  As only lengths matter for the packing, the whole
corpus is a histogram of at most `capacity` counts, whatever its size; that histogram alone
reaches the driver, where `pack_lengths` finds fillings with multiplicities:

* incumbent: best-fit decreasing, whole groups of equal bins at a time;
* bin completion: the largest open length gets the undominated fillings of the room beside
  it, by rising waste, and each is tried as often as the counts allow and once.  A filling
  is dominated if one open length could take the place of some of its members.  A branch
  ends where its waste leaves no solution with fewer bins than the incumbent; the search
  ends at the lower bound (Martello and Toth's L2) or after `nodes` and four steps for each
  distinct length, with the best solution found so far, which is always whole.

Every piece then looks up its place: its rank among the pieces of its length, from running
counts over ranges (a length that a third of all pieces share is spread over many tasks),
gives the filling, the bin and the offset.  Equal inputs give equal packings.

Defined results: a null or empty text has the end id alone; rows count each, equal or not,
whatever their id; columns other than id and text are left out by `pieces`, all columns are
kept by `pack`, which takes names for its own that are new.  Words (runs of characters other
than \\x20 and \\x09-\\x0D) are tokenised once and looked up after that, which is the same as
whole texts where the tokenizer never joins over white space; the tests compare both.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import prefix_sums, text_batches

CAPACITY = 4096
#: Bytes of text that a worker looks up at once, and of words and ids that it remembers; search steps
#: besides four for each distinct length.
BLOCK_BYTES = 4 << 20
CACHE_BYTES = 160 << 20
NODES = 4000


# ------------------------------------------------------------------ tokens

#: How the public word-BPE tokenizer normalises and cuts a text before its merges.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of plain marks, digits and Latin letters, which have one small form each, and the same cuts for them.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_CUTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")


class WordTokens(dict):
    """Ids of words as little-endian 32-bit numbers, remembered up to a number of bytes.

    Plain words are cut here, where the tokenizer is known to cut them so, and only their
    parts get its merges; all other words go through the tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.held = 0
        told = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        split = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.cuts = steps == NORMALIZER and split.get("pattern") == {"Regex": CUTS} and split.get("invert")

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.cuts or "<|" in text or not PLAIN.fullmatch(text):  # special tokens are matched as they are
            packed = self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            small = text.lower()
            parts = PLAIN_CUTS.findall(small)
            if len(parts) > 1 or small != text:
                packed = b"".join([self[p.encode()] for p in parts])
            else:
                packed = self.packed([t.id for t in self.model.tokenize(text.translate(self.letters))])
        self[word] = packed
        self.held += len(word) + len(packed) + 200
        return packed

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return b"".join([x.to_bytes(4, "little") for x in ids])

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; its distinct words are looked up once."""
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        words = pc.ascii_split_whitespace(texts)  # empty words at either end have no ids
        starts = words.offsets.to_numpy()
        found = words.flatten().dictionary_encode()
        own = pa.array([self[w] for w in found.dictionary.cast(pa.large_binary()).to_pylist()], pa.large_binary())
        all_ids = own.take(found.indices)
        at = np.frombuffer(all_ids.buffers()[1], np.int64)[all_ids.offset:][starts - starts[0]]
        data = all_ids.buffers()[2]
        data = memoryview(data) if data is not None else b""
        return [bytes(data[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


_TOKENS: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, vocabulary: Callable[[], str], end_id: int = 1, capacity: int = CAPACITY,
           keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its ids (little-endian 32-bit numbers).

    `vocabulary` gives the tokenizer's path where it is called, in each worker.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        path = vocabulary()
        if path not in _TOKENS:
            _TOKENS[path] = WordTokens(path)
        tokens = _TOKENS[path]
        for b in batches:
            texts = b.column("text").cast(pa.large_string()).fill_null("")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
                rows: list = [[], [], [], [], [], []]
                for i, own in enumerate(tokens.ids(texts[at:to]), at):
                    own += end
                    for piece, a in enumerate(range(0, len(own), width)):
                        cut = own[a:a + width]
                        for column, value in zip(rows, (i, piece, a // 4, len(cut) // 4, zlib.crc32(cut), cut)):
                            column.append(value)
                columns = [b.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                           *[pa.array(r, pa.int64()) for r in rows[2:5]]]
                if keep_ids:
                    columns.append(pa.array(rows[5], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    return text_batches(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# ------------------------------------------------------------------ fillings

Filling = tuple[int, tuple[int, ...]]  # how many bins, lengths in each


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: bins that any packing needs."""
    number, words = [0] * (capacity + 2), [0] * (capacity + 2)  # of all lengths below
    for s in range(capacity + 1):
        number[s + 1] = number[s] + counts.get(s, 0)
        words[s + 1] = words[s] + s * counts.get(s, 0)
    half, best = capacity // 2, -(-words[-1] // capacity)
    for k in range(half + 1):
        long = max(capacity - k, half)
        shared = number[long + 1] - number[half + 1]
        room = shared * capacity - (words[long + 1] - words[half + 1])
        rest = words[half + 1] - words[k]
        best = max(best, number[-1] - number[half + 1] + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing with groups of equal bins."""
    rooms: list[int] = []  # rooms that some group has, rising
    groups: dict[int, list[list]] = {}  # room: [bins, lengths]

    def add(room, bins, held):
        if room not in groups:
            rooms.insert(bisect_left(rooms, room), room)
            groups[room] = []
        groups[room].append([bins, held])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                if left >= each:
                    add(capacity - each * size, left // each, (size,) * each)
                if left % each:
                    add(capacity - left % each * size, 1, (size,) * (left % each))
                break
            room = rooms[i]
            bins, held = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            used = min(left, bins)
            if used < bins:
                add(room, bins - used, held)
            add(room - size, used, (*held, size))
            left -= used
    return [(bins, held) for found in groups.values() for bins, held in found]


def dominated(filling: tuple[int, ...], slack: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Whether one open length could stand for some members of the filling and use as much or more."""
    used = Counter(filling)
    sums = {0: 0}  # sum of some members: how many
    for x in filling:
        sums |= {s + x: n + 1 for s, n in sums.items() if s + x not in sums}
    for s, n in sums.items():
        if not n:
            continue
        i = bisect_left(sizes, s)
        while i < len(sizes) and sizes[i] <= s + slack:
            y = sizes[i]
            if counts[y] > used[y] and not (n == 1 and y == s):
                return True
            i += 1
    return False


def completions(counts: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the room with at most that waste, by rising waste.

    An exact single length dominates all others; exact pairs need no search; the others
    are read off the sums that the lengths from each place on can reach.
    """
    if counts.get(room, 0):
        yield (room,)
        return
    given = set()
    for x in range(room - 1, (room - 1) // 2, -1):
        y = room - x
        if counts.get(x, 0) and counts.get(y, 0) > (x == y):
            given.add((x, y))
            yield x, y
    sizes = sorted(s for s, c in counts.items() if c and s <= room)
    if not sizes:
        if room <= most_waste:
            yield ()
        return
    down = sizes[::-1]
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for s in sizes:  # sums of the lengths up to s, each as often as it is there
        sums, left, step = reach[-1], min(counts[s], room // s), 1
        while left and sums != mask:
            step = min(step, left)
            sums |= sums << (step * s) & mask
            left, step = left - step, 2 * step
        reach.append(sums)
    reach.reverse()  # reach[k]: of down[k:]

    def exact(left, k, held):
        """The ways to fill `left` with down[k:], largest members first; none is searched in vain."""
        if not left:
            yield held
        while left and reach[k] >> left & 1:
            size = down[k]
            for n in range(min(counts[size], left // size), 0, -1):
                if reach[k + 1] >> (left - n * size) & 1:
                    yield from exact(left - n * size, k + 1, held + (size,) * n)
            k += 1

    for waste in range(0, min(most_waste, room) + 1):
        for held in exact(room - waste, 0, ()):
            if held not in given and not dominated(held, waste, sizes, counts):
                yield held


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Filling]:
    """Fillings of as few bins as the search finds: bin completion with branch and bound."""
    counts = {s: c for s, c in counts.items() if c}
    total = sum(s * c for s, c in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(m for m, _ in best)
    open_ = dict(counts)
    order = sorted(counts, reverse=True)

    def largest(at):
        while at < len(order) and not open_[order[at]]:
            at += 1
        return at

    def tries(at, waste):
        """(times, filling) for the largest open length, within what may be wasted."""
        size = order[at]
        for held in completions({**open_, size: open_[size] - 1}, capacity - size, (best_bins - 1) * capacity - total - waste):
            need = Counter((size, *held))
            times = min(open_[s] // n for s, n in need.items())
            yield times, (size, *held)
            if times > 1:
                yield 1, (size, *held)

    def put(times, held):
        for s in held:
            open_[s] -= times

    path: list[Filling] = []
    at = largest(0)
    # A step keeps the place, the waste before it and how many tries are done, not the tries themselves:
    # what a filling's sums take is needed for one step only, the tries before are found again on the way back.
    stack = [[at, 0, 0]] if at < len(order) and best_bins > least else []
    spent = 0
    while stack and best_bins > least and spent <= nodes + 4 * len(order):
        spent += 1
        at, waste, done = stack[-1]
        for times, held in islice(tries(at, waste), done, None):
            stack[-1][2] += 1
            more = waste + times * (capacity - sum(held))
            if more <= (best_bins - 1) * capacity - total:
                break
        else:
            stack.pop()
            if path:
                times, held = path.pop()
                put(-times, held)
            continue
        put(times, held)
        path.append((times, held))
        then = largest(at)
        if then < len(order):
            stack.append([then, more, 0])
        else:
            bins = sum(times for times, _ in path)
            if bins < best_bins:
                best, best_bins = list(path), bins
            path.pop()
            put(-times, held)
    return sorted(best, key=lambda f: (tuple(-s for s in f[1]), f[0]))


def slots(fillings: list[Filling]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(length, first rank, ranks, first bin, per bin, offsets): which pieces of a length go where."""
    out, ranks, bins = [], Counter(), 0
    for times, held in fillings:
        offsets: dict[int, list[int]] = {}
        at = 0
        for s in held:
            offsets.setdefault(s, []).append(at)
            at += s
        for s, places in offsets.items():
            out.append((s, ranks[s], times * len(places), bins, len(places), places))
            ranks[s] += times * len(places)
        bins += times
    return out


def pack(found: DataFrame, order: list[str], capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """The pieces with `sequence_id` and `offset`; `order` tells pieces of one length apart."""
    spark = found.sparkSession
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    table = spark.createDataFrame(
        slots(pack_lengths(counts, capacity, nodes)),
        "length long, _first long, _ranks long, _bin long, _each long, _offsets array<long>")
    ranked = prefix_sums(found.withColumn("_one", F.lit(1)), "length", [*order, "_row"], "_one", "_rank")
    placed = ranked.join(F.broadcast(table), "length").where("_rank >= _first and _rank < _first + _ranks")
    return placed.select(*[c for c in found.columns if c != "_row"],
                         F.expr("_bin + (_rank - _first) div _each").alias("sequence_id"),
                         F.expr("_offsets[cast((_rank - _first) % _each as int)]").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence, for packed pieces that still have `ids`."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.expr("aggregate(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids), X'', (a, x) -> concat(a, x))").alias("ids"))
