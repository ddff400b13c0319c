"""Exact top-k search: tiled matrix products, selection per tile, tree merging.

Candidates are packed into shards of `shard_rows` rows where they are read (no
shuffle), queries into blocks.  A task takes some blocks and one group of shards and
holds one tile at a time; nothing is broadcast, and neither side is copied in a
shuffle, as a Cartesian product reads the dealt groups again.  A block keeps k rows
per query of the shards that it meets in a row; lists are merged `fan_in` at a time
until each query has one.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import pieces

TILE = "qid long, qkey long, top array<struct<neg: long, vec_id: long>>, shard long"


def usable(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, vec) with integer components floor(scale * x); unusable vectors are left out."""
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
            .select("id", F.size("v").alias("dim"),
                    F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vec")))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them all."""
    lo, hi = x.min(initial=0), x.max(initial=0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64)
                         if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def widen(mat: bytes, rows: int, dim: int) -> np.ndarray:
    """The matrix that `narrow` made the bytes of."""
    width = len(mat) // (rows * dim) if dim else 8
    return np.frombuffer(mat, f"i{width}").astype(np.int64).reshape(rows, dim)


def pack_shards(shard_rows: int):
    def pack(batches):
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def flush(dim):
            ids = np.concatenate([a for a, _ in held[dim]])
            vecs = np.concatenate([b for _, b in held[dim]])
            held[dim], count[dim] = [], 0
            order = np.argsort(ids, kind="stable")
            for at in range(0, len(ids), shard_rows):
                pick = order[at:at + shard_rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([ids[pick].tobytes()], pa.binary()),
                     pa.array([narrow(vecs[pick]).tobytes()], pa.binary())], ["dim", "ids", "mat"])

        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            flat = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(dims, dtype=np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                at = (ends[rows] - dim)[:, None] + np.arange(dim)
                held.setdefault(int(dim), []).append((ids[rows].astype(np.int64), flat[at]))
                count[int(dim)] = count.get(int(dim), 0) + len(rows)
                if count[int(dim)] >= shard_rows:
                    yield from flush(int(dim))
        for dim in list(held):
            if held[dim]:
                yield from flush(dim)
    return pack


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; floats only where every partial sum is below 2**53."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2.0 ** 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2.0 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    big = q.astype(object) @ c.astype(object).T
    return np.clip(big, -(2 ** 63 - 1), 2 ** 63 - 1).astype(np.int64)


def tile_top(qids, q, ids, c, k):
    """Per query (scores, ids) of its k best rows of one tile, best first, ties to the smaller id."""
    score = products(q, c)
    n, out = len(ids), []
    score_fits = np.abs(score).max(initial=0) < 2 ** 62 // max(n, 1)
    own = qids[:, None] == ids[None, :]
    if score_fits:  # ids ascend, so score and position make one key without ties
        key = score * n + (n - 1 - np.arange(n))
        key[own] = np.iinfo(np.int64).min
        m = min(k, n)
        best = np.argpartition(key, n - m, axis=1)[:, n - m:]
        for r in range(len(qids)):
            i = best[r][np.argsort(-key[r, best[r]], kind="stable")]
            i = i[~own[r, i]]
            out.append((score[r, i], ids[i]))
    else:
        for r in range(len(qids)):
            i = np.lexsort((ids, -score[r]))
            i = i[~own[r, i]][:k]
            out.append((score[r, i], ids[i]))
    return out


def merge_top(found: list, k: int) -> list:
    """Per query the k best rows of the lists in `found`, one list of (scores, ids) per tile."""
    out = []
    for lists in zip(*found):
        score, ids = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
        best = np.lexsort((ids, -score))[:k]
        out.append((score[best], ids[best]))
    return out


def search_tiles(k: int, fan_in: int):
    def search(batches):
        schema = pa.schema([("qid", pa.int64()), ("qkey", pa.int64()),
                            ("top", pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))),
                            ("shard", pa.int64())])

        def lists():
            top = merge_top(found, k)
            ends = np.cumsum([0] + [len(x[1]) for x in top]).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(-np.concatenate([x[0] for x in top])), pa.array(np.concatenate([x[1] for x in top]))],
                ["neg", "vec_id"])
            return pa.RecordBatch.from_arrays(
                [pa.array(qids), pa.array(qkeys), pa.ListArray.from_arrays(pa.array(ends), pairs),
                 pa.array(np.full(len(qids), shard, np.int64))], schema=schema)

        held, found = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("dim")[row].as_py()
                ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
                c = widen(batch.column("mat")[row].as_py(), len(ids), dim)
                at = dim, batch.column("b")[row].as_py()
                if at != held:  # a block comes with all shards of the task in a row
                    if found:
                        yield lists()
                    block = batch.column("block")[row].values
                    qids = block.field("id").to_numpy(zero_copy_only=False).copy()
                    qkeys = block.field("qkey").to_numpy(zero_copy_only=False).copy()
                    q = block.field("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    q = q.reshape(len(qids), dim)
                    held, found, shard = at, [], batch.column("shard")[row].as_py()
                found.append(tile_top(qids, q, ids, c, k))
                if len(found) >= fan_in:
                    found = [merge_top(found, k)]
        if found:
            yield lists()
    return search


def exact_top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                k: int = 20, scale: int = 64, shard_rows: int = 4096, block_rows: int = 512,
                fan_in: int = 16) -> DataFrame:
    """The k rows of `vectors` with the highest integer inner product for each row of `queries`.

    Returns (query_id, rank from 1, vec_id, score).  Components are floor(scale * x).
    Rows without an id, without a vector, or with a null or non-finite component take
    no part.  Vectors of another length than the query's are not its candidates.  A
    query's own id is never its candidate; other repeated rows count one by one.
    Repeated query rows with equal vectors are one query.  Ties go to the smaller
    vec_id.  Empty inputs give an empty result.  Other columns are ignored.
    """
    shards = usable(vectors, vec_id, vector, scale).mapInArrow(
        pack_shards(shard_rows), "dim int, ids binary, mat binary")
    shards = materialize(shards.withColumn("shard", F.xxhash64("ids", "mat")), "topk-shards")
    asked = (usable(queries, vec_id, vector, scale).distinct()
             .withColumn("qkey", F.xxhash64("id", "vec")))
    asked = materialize(asked, "topk-queries")
    n_shards, n_blocks = shards.count(), pieces(asked.count(), block_rows)
    # about four tasks a core while a group has four shards at least; a task keeps one group in memory
    tasks = 4 * shards.sparkSession.sparkContext.defaultParallelism
    groups = max(min(pieces(n_shards, 4), tasks), pieces(n_shards, 16))
    blocks = (asked.withColumn("b", F.pmod("qkey", F.lit(n_blocks)).cast("int"))
              .groupBy("dim", "b").agg(F.collect_list(F.struct("id", "qkey", "vec")).alias("block"))
              .repartition(min(n_blocks, pieces(tasks, groups))))
    # the size of `blocks` is estimated from packed files, so Spark would broadcast gigabytes
    tiles = (blocks.hint("shuffle_replicate_nl").join(shards.repartition(groups), "dim")
             .select("dim", "b", "ids", "mat", "block", "shard"))
    lists = tiles.mapInArrow(search_tiles(k, fan_in), TILE)
    left = groups
    while True:  # each round merges about fan_in lists of a query
        left = pieces(left, fan_in)
        best = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = (lists.withColumn("shard", F.pmod("shard", F.lit(left)))
                 .groupBy("qid", "qkey", "shard").agg(best))
        if left == 1:
            break
    return (lists.select("qid", F.posexplode("top").alias("pos", "hit"))
            .select(F.col("qid").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score")))
