"""MinHash near-dedup by a Chosen-Path set similarity join.

Documents with equal shingle sets are one class.  A class is embedded as `coordinates`
minwise tokens.  A tree starts with all classes in its root; a node picks coordinates
from its own path and deals its classes by the token that they have there.  Independent
trees are repeated until a pair at the threshold is met with the target recall.

Only components are asked for, so what is in one component is settled.  A node is small
if at most `leaf` of its classes are outside its largest component: these are compared
with the whole node, in tiles.  In any other node some leaders are compared with all, and
it branches on.  Compared are sketches of one byte per bin.  Of the pairs that may reach
the threshold a tile hands on a spanning forest, the likeliest first, so a group of n
classes gives a small multiple of n pairs, not all of them; those are confirmed on the
full shingle sets.  Nodes in which a pair was refuted while others waited behind it are
compared again without the refuted pairs, in the components known by then, and in the end
with all pairs that are left; so no link between different components is missed.
"""
from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import few_files, materialize
from .common import salted_lookup, sized, text_batches
from .components import connected
from .tokens import blocks, shingle_numbers, text_bytes, word_numbers

SKETCH = "doc_id long, n_shingles long, fp binary, sig array<int>, tiny binary"


def text_shingles(column: pa.Array, width: int):
    """Row by row the distinct shingle numbers of a text column."""
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        numbers, words = word_numbers(data, offsets[a:b + 1])
        shingles, ends = shingle_numbers(numbers, words, width)
        for i in range(b - a):
            yield shingles[ends[i]:ends[i + 1]]


def minwise(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    best = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        part = np.multiply.outer(mul, x[at:at + 4096])
        part += add[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def binned(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One byte per bin: 0 for an empty one, else a byte of its smallest shingle; then the size in four bytes."""
    where = (shingles & np.uint64(bins - 1)).astype(np.int64)
    least = np.full(bins, 2 ** 64 - 1, np.uint64)
    np.minimum.at(least, where, shingles)
    out = ((least >> np.uint64(20)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    out[least == 2 ** 64 - 1] = 0
    return np.concatenate([out, np.array([len(shingles)], np.uint32).view(np.uint8)])


def sketcher(width: int, coordinates: int, bins: int, seed: int):
    def sketch(batches):
        rng = np.random.default_rng(seed)
        mul = rng.integers(0, 2 ** 32, coordinates, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 2 ** 32, coordinates, dtype=np.uint32)
        for b in batches:
            sizes, prints, sigs, tiny = [], [], [], []
            for own in text_shingles(b.column("text"), width):
                sizes.append(len(own))
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sigs.append(minwise(own, mul, add))
                tiny.append(binned(own, bins).tobytes())
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.uint32)
            ends = np.arange(0, len(flat) + 1, coordinates, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32))), pa.array(tiny, pa.binary())],
                ["doc_id", "n_shingles", "fp", "sig", "tiny"])
    return sketch


def set_maker(width: int):
    def sets(batches):
        for b in batches:
            ids, held, size = [], [], 0
            for i, own in zip(b.column("id").to_pylist(), text_shingles(b.column("text"), width)):
                ids.append(i)
                held.append(own)
                size += len(own)
                if size > 1 << 19:
                    yield set_batch(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield set_batch(ids, held)
    return sets


def set_batch(ids, held):
    ends = np.cumsum([0] + [len(x) for x in held]).astype(np.int32)
    flat = np.concatenate(held).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "shingles"])


def ones(flags: np.ndarray) -> np.ndarray:
    """How many of each row's flags are set: bytes are added eight at a time, as each counts at most 255 of them."""
    out = np.zeros(len(flags), np.int64)
    for at in range(0, flags.shape[1], 2040):
        part = flags[:, at:at + 2040]
        if part.shape[1] % 8:
            part = np.pad(part, ((0, 0), (0, -part.shape[1] % 8)))
        lanes = np.ascontiguousarray(part).view(np.uint64).sum(axis=1, dtype=np.uint64)
        wide = np.uint64(0x00FF00FF00FF00FF)
        lanes = (lanes & wide) + (lanes >> np.uint64(8) & wide)
        out += (lanes * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)
    return out


class Sketches:
    """The sketches of some classes, as rows, to be compared with one sketch after another."""

    def __init__(self, rows: np.ndarray):
        self.bins = np.ascontiguousarray(rows[:, :-4])
        self.filled = self.bins > 0
        self.held = ones(self.filled)
        self.flags = np.empty(self.bins.shape, bool)
        self.sizes = rows[:, -4:].copy().view(np.uint32)[:, 0].astype(np.float64)

    def likely(self, other: Sketches, k: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows whose set may reach the similarity with row k of `other`, and the estimated similarities.

        The bins that either set fills sample its union without replacement; 4.5 deviations
        below the threshold and one bin still count.
        """
        bins = len(other.bins[k])
        equal = np.equal(self.bins, other.bins[k], out=self.flags)
        if other.held[k] == bins:
            same = ones(equal)
            at = np.flatnonzero(same >= similarity * bins - 4.5 * math.sqrt(similarity * (1 - similarity) * bins) - 1)
            held = np.full(len(at), bins)
        else:
            same = ones(np.logical_and(equal, other.filled[k], out=equal))
            held = np.maximum(ones(np.logical_or(self.filled, other.filled[k], out=self.flags)), 1)
            at = np.flatnonzero(same >= similarity * held - 4.5 * np.sqrt(similarity * (1 - similarity) * held) - 1)
            held = held[at]
        same = same[at]  # the rest can't, as the spread is at most that
        if not len(at):
            return at, same
        union = (self.sizes[at] + other.sizes[k]) / (1 + similarity)
        spread = np.sqrt(similarity * (1 - similarity) * held * np.clip((union - held) / np.maximum(union - 1, 1), 0, 1))
        good = same >= similarity * held - 4.5 * spread - 1
        return at[good], (same[good] + 1e-9) / held[good]


def unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, comps = rows.field("id").to_numpy(), rows.field("comp").to_numpy()
    return ids, comps, np.frombuffer(b"".join(rows.field("tiny").to_pylist()), np.uint8).reshape(len(ids), -1)


def forest(scores: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of a spanning forest of the edges (left, right), greatest scores first."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k in np.lexsort((right, left, -scores)).tolist():
        a, b = root(int(left[k])), root(int(right[k]))
        if a != b:
            parent[a] = b
            kept.append(k)
    return np.array(kept, np.int64)


PAIRS = "node long, a long, b long, more boolean"


def compare_tiles(similarity: float, spanning: bool):
    """Pairs of a tile's classes with its node's probes in another component that may reach the similarity.

    With `spanning`, a forest of them over the components; `more` says that others wait behind it
    (in a small node: the others are met again by their children).  Without it all of them, each
    in the least node that both are in only: classes hold the nodes that they have `met` in.
    """
    def compare(batches):
        for b in batches:
            for node, small, tile, probes in zip(b.column("node").to_pylist(), b.column("small").to_pylist(),
                                                 b.column("tile"), b.column("probes")):
                ids, comps, sketches = unpacked(tile.values)
                refuted = [set(x or ()) for x in tile.values.field("no").to_pylist()]
                before, asked_before = ([] if spanning else [{n for n in x if n < node} for x in side.values.field("met").to_pylist()]
                                        for side in (tile, probes))
                found: list = []
                asked, asked_comps, asked_sketches = unpacked(probes.values)
                held, asked_sketches = Sketches(sketches), Sketches(asked_sketches)
                for at, (i, comp) in enumerate(zip(asked.tolist(), asked_comps.tolist())):
                    near, scores = held.likely(asked_sketches, at, similarity)
                    for k, score in zip(near.tolist(), scores.tolist()):
                        if (comps[k] != comp and ids[k] != i and i not in refuted[k]
                                and (spanning or before[k].isdisjoint(asked_before[at]))):
                            found.append((score, *sorted((i, int(ids[k]))), *sorted((comp, int(comps[k])))))
                pairs = sorted(set(found))
                kept = range(len(pairs))
                if spanning and pairs:
                    scores, _, _, x, y = (np.array(c) for c in zip(*pairs))
                    kept = forest(scores, x, y).tolist()
                more = small and len(kept) < len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node] * len(kept), pa.int64()), pa.array([pairs[k][1] for k in kept], pa.int64()),
                     pa.array([pairs[k][2] for k in kept], pa.int64()), pa.array([more] * len(kept), pa.bool_())],
                    ["node", "a", "b", "more"])
    return compare


def branch(at: DataFrame, coordinates: int, more: float) -> DataFrame:
    """The rows dealt to the node's children: one chosen coordinate, and a second one with a chance of `more`."""
    pick = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(coordinates)).cast("int") for k in (1, 2)]
    second = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < int(more * 1000)
    child = [F.xxhash64("node", p, F.element_at("sig", p + 1)) for p in pick]
    return at.select("id", "comp", "rank", F.explode(
        F.when(second, F.array(*child)).otherwise(F.array(child[0]))).alias("node"))


def roots(sigs: DataFrame, trees: int, coordinates: int, more: float) -> list[DataFrame]:
    """(node, id) of each tree's first level; the trees' coordinates are constants, all different."""
    rng = random.Random(11)
    order = rng.sample(range(coordinates), coordinates)
    out = []
    for t in range(trees):
        chosen = order[2 * t % coordinates:2 * t % coordinates + 2][:2 if rng.random() < more else 1]
        nodes = [F.xxhash64(F.lit(t), F.lit(i), F.element_at("sig", i + 1)) for i in chosen]
        out.append(F.array(*nodes))
    return [sigs.select("id", F.explode(F.flatten(F.array(*part))).alias("node")) for part in (out[:FIRST_TREES], out[FIRST_TREES:]) if part]


def compare_nodes(at: DataFrame, sketches: DataFrame, leaf: int, leaders: int, similarity: float,
                  spanning: bool = True, refuted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Likely pairs (node, a, b, more) of nodes (node, id, comp, rank, ...), and the rows of the nodes to branch.

    A node's probes are the classes outside its largest component if they are at most
    `leaf`, which settles it, or else its `leaders` best classes by rank.
    """
    nodes = (at.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m"))
             .groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("top"))
             .where("n > top.m").select("node", "n", (F.col("n") - F.col("top.m")).alias("rest"), F.col("top.comp").alias("lead")))
    own = at.select("node", "id", "comp", "rank").join(nodes, "node").join(sketches, "id")
    if refuted is None:
        own = own.withColumn("no", F.lit(None).cast("array<long>"))
    else:
        both = refuted.select(F.col("a").alias("id"), "b").unionAll(refuted.select("b", "a"))
        own = own.join(both.groupBy("id").agg(F.collect_set("b").alias("no")), "id", "left")
    if spanning:
        own = own.withColumn("met", F.lit(None).cast("array<long>"))
    else:
        own = own.join(at.groupBy("id").agg(F.collect_set("node").alias("met")), "id")
    s = ["id", "comp", "tiny", "no", "met"]
    own = few_files(own.select("*", F.struct(*s).alias("s")).drop(*s), "near-tiles", 16)
    tile = F.pmod(F.xxhash64("s.id"), F.ceil(F.col("n") / 256))
    tiles = own.groupBy("node", tile.alias("t")).agg(
        F.collect_list("s").alias("tile"), (F.max("rest") <= leaf).alias("small"))
    # probes in parts of about 512, however many a node has
    outside = (own.where((F.col("rest") <= leaf) & (F.col("s.comp") != F.col("lead")))
               .select("node", F.pmod(F.xxhash64("s.id", F.lit(9)), F.ceil(F.col("rest") / 512)).alias("part"), "s"))
    # the best of each of 64 parts of a node, then the best of these
    best = (own.where(F.col("rest") > leaf).groupBy("node", F.pmod(F.xxhash64("s.id", F.lit(5)), F.lit(64)))
            .agg(F.min(F.struct("rank", "s.id", "s.comp", "s.tiny", "s.met")).alias("b")).groupBy("node")
            .agg(F.slice(F.sort_array(F.collect_list("b")), 1, leaders).alias("b"))
            .select("node", F.lit(0).cast("long").alias("part"), F.explode("b").alias("b")))
    slim = lambda c: F.struct(f"{c}.id", f"{c}.comp", f"{c}.tiny", f"{c}.met").alias("s")
    probes = (outside.select("node", "part", slim("s")).unionAll(best.select("node", "part", slim("b")))
              .groupBy("node", "part").agg(F.collect_list("s").alias("probes")))
    pairs = tiles.join(probes, "node").select("node", "small", "tile", "probes").mapInArrow(compare_tiles(similarity, spanning), PAIRS)
    left = own.where(F.col("rest") > leaf).select("node", F.col("s.id").alias("id"), F.col("s.comp").alias("comp"), "rank")
    return few_files(pairs, "near-likely", 16), left


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = texts.join(sized(few_files(wanted, "near-wanted")), "id", "left_semi").mapInArrow(
        set_maker(width), "id long, shingles array<long>")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return few_files(both.withColumn("s", shared)
                       .where(F.col("s") * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b"), "near-links", 16)


#: Trees of the first pass; the others meet the components that it has found.
FIRST_TREES = 3


def join_sets(sigs: DataFrame, docs: DataFrame, links: DataFrame, width: int, percent: int, trees: int, depth: int,
              leaf: int, leaders: int, coordinates: int, more: float) -> DataFrame:
    """(id, comp) of the classes that have links: those found by the trees, and the given ones.

    The first trees' nodes are compared by forests, then those of the others, and the first
    ones' again where a pair was refuted, in the components of the first pass: a group that
    is one component by then gives no more pairs.  What is left of nodes with refuted pairs
    is compared in a last pass with all pairs.
    """
    similarity = percent / 100
    sketches = sigs.select("id", "tiny")
    parts = [few_files(part.distinct(), "near-paths", 16) for part in roots(sigs, trees, coordinates, more)]
    at = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    # classes that meet others under many coordinates are close to many: the best leaders
    large = at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).select("node", F.lit(True).alias("large"))
    often = (at.join(sized(few_files(large, "near-large")), "node", "left")
             .groupBy("id").agg((-F.count("large")).alias("rank")).where("rank < 0"))
    levels = [part.join(often, "id", "left").select("node", "id", F.coalesce("rank", F.lit(0)).alias("rank")) for part in parts]

    def settled(pairs, links, tried):
        """Links, tried and refuted pairs after these, and the nodes that have more pairs behind a refuted one."""
        new = pairs.select("a", "b").distinct()
        new = few_files(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "near-tried")
        links = links.unionAll(confirmed(new, docs, width, percent))
        tried = new if tried is None else tried.unionAll(new)
        refuted = few_files(tried.join(links, ["a", "b"], "left_anti"), "near-refuted")
        again = pairs.where("more").join(refuted, ["a", "b"], "left_semi").select("node").distinct()
        return links, tried, refuted, few_files(again, "near-again")

    def known(rows, again, comp):
        """The rows of all levels' nodes `again` and the given ones, with their components."""
        for level in levels:
            rows = rows.unionAll(level.join(again, "node", "left_semi").select("node", "id", "rank"))
        return rows.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    pairs, at = compare_nodes(levels[0].withColumn("comp", F.col("id")), sketches, leaf, leaders, similarity)
    links, tried, refuted, again = settled(pairs, links, None)
    comp = connected(links)
    rest = at.select("node", "id", "rank")
    rest = rest if len(levels) == 1 else rest.unionAll(levels[1].select("node", "id", "rank"))
    at = known(rest, sized(again), comp)
    found, at = compare_nodes(at, sketches, leaf, leaders, similarity, refuted=refuted)
    for level in range(depth):
        if at.isEmpty():
            break
        at = few_files(branch(at.join(sigs.select("id", "sig"), "id"), coordinates, more), "near-paths", 16)
        levels.append(at.select("node", "id", "rank"))
        last = level == depth - 1  # what is left then is compared whole, however large
        deeper, at = compare_nodes(at, sketches, leaf if not last else 2 ** 62, leaders, similarity)
        found = found.unionAll(deeper)
    links, tried, refuted, again = settled(found, links, tried)
    comp = connected(links)
    if again.isEmpty():
        return comp
    rows = known(levels[0].limit(0), sized(again), comp)
    pairs, _ = compare_nodes(rows, sketches, 2 ** 62, leaders, similarity, False, refuted)
    return connected(settled(pairs, links, tried)[0])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 14, depth: int = 40,
                    leaf: int = 512, leaders: int = 16, coordinates: int = 128, more: float = 0.25, bins: int = 512,
                    seed: int = 7) -> DataFrame:
    """Near-duplicate component of every document (doc_id, text): one row per input row.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links of
    `percent` or more Jaccard similarity) and kept (doc_id is component_id).  Words are
    lower-cased (A-Z) runs between white space; a document with fewer than `width` words
    has its whole sequence as its only shingle; without words it is linked with nothing.

    `more` is the chance of a second branch; 1 / similarity - 1 or more keeps linked pairs
    together on average.  Rows that share a doc_id are one document with several texts:
    they are linked.  A null doc_id takes no part, has no component and is kept.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    sketches = materialize(
        text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(sketcher(width, coordinates, bins, seed), SKETCH), "near-sketches")
    rows = sketches.select("doc_id", "n_shingles", "fp")
    part = rows.where("doc_id is not null and fp is not null")
    copied = few_files(part.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                         .where("copies > 1").select("fp", "rep"), "near-copied")
    placed = materialize(salted_lookup(part, copied, ["fp"])
                         .select("doc_id", "fp", F.coalesce("rep", "doc_id").alias("rep")), "near-placed")
    # a doc_id with several texts links their classes
    again = (placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.collect_set("rep").alias("r"))
             .where("a <> z").select("a", F.explode("r").alias("b")).where("a <> b"))
    # one text of each class stands for it: all rows but the copies
    copies = sized(few_files(placed.where("rep <> doc_id").select("fp", "doc_id").distinct(), "near-copies"))
    stands = (sketches.where("doc_id is not null and fp is not null").join(copies, ["fp", "doc_id"], "left_anti"))
    if not part.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        stands = stands.dropDuplicates(["fp", "doc_id"])
    sigs = materialize(stands.select(F.col("doc_id").alias("id"), "sig", "tiny"), "near-sigs")
    comp = join_sets(sigs, docs, again, width, percent, trees, depth, leaf, leaders, coordinates, more)
    comp = comp.select(F.col("id").alias("rep"), "comp").where("rep <> comp")
    known = salted_lookup(placed, comp, ["rep"]).select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    known = known.groupBy("doc_id").agg(F.min("comp").alias("component_id"))
    out = rows.join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each near-duplicate component (options of `near_duplicates`); all columns.

    Rows that repeat a doc_id are one document: the smallest by text, then by the other
    columns, stays.  Rows without a doc_id stay.
    """
    found = materialize(near_duplicates(docs, **options).select("doc_id", "kept").distinct(), "near-kept")
    gone = sized(materialize(found.where("not kept").select("doc_id"), "near-gone"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = (docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
                .where("_n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    others = [c for c in docs.columns if c != "text"]
    many = (left.join(repeated, "doc_id", "left_semi").groupBy("doc_id")
            .agg(F.min(F.struct("text", *[F.col(c) for c in others])).alias("_r")).select(*[F.col(f"_r.{c}") for c in docs.columns]))
    return once.unionByName(many)
