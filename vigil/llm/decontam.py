"""Benchmark decontamination by size-partitioned MinHash containment, on DataFrame functions only.

Benchmark items are partitioned by the size of their shingle set.  Each keeps the
smallest hashes of its set (its minwise sample: 16, or a sixteenth of the partition's
upper size if that is more; small items their whole set).  A document that contains a
share of 0.8 of an item holds each sampled shingle with that chance, however long the
document is, so sampled shingles found in the document estimate the containment.  Each
partition has the number of hits below which an item that is contained is met with a
chance of at most one in a million.  Candidates are verified on all their shingles.
"""
from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import fresh, WORD, sized

MISS = 1e-6


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of the runs of `width` words; none if there are fewer words."""
    run = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)),
                      lambda i: F.xxhash64(F.lit(width), *[F.element_at(words, i + j) for j in range(width)]))
    return F.when(F.size(words) >= width, run)


def sample_size(upper: int) -> int:
    return max(16, upper // 16)


def hits_needed(size: int, sample: int, percent: int) -> int:
    """Most hits that a contained item of this size shows with a chance of at least 1 - MISS."""
    sample, inside = min(sample, size), -(-percent * size // 100)
    missed, need = 0.0, 0
    for hits in range(sample + 1):
        if sample - hits <= size - inside and hits <= inside:
            missed += comb(inside, hits) * comb(size - inside, sample - hits) / comb(size, sample)
        if missed > MISS:
            break
        need = hits + 1
    return max(1, need)


def size_partitions(largest: int, percent: int) -> list[tuple[int, int, int]]:
    """(upper size, sample size, hits needed) of each partition; upper sizes double from 16 on."""
    out, upper = [], 16
    while True:
        sample = sample_size(upper)
        sizes = range(upper // 2 + 1, upper + 1, max(1, upper // 64)) if upper > 16 else [upper]
        out.append((upper, sample, min(hits_needed(n, sample, percent) for n in sizes)))
        if upper >= largest:
            return out
        upper *= 2


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """(item, item_id, width, shingles): distinct shingle hashes; an item with fewer words has its whole sequence as one.

    `item` is the key of a distinct (item_id, text), null ids included.
    """
    item = F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item")
    words = (items.where("text is not null").select(item, "item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0"))
    k = F.least(F.size("w"), F.lit(width))
    sets = F.coalesce(*[F.when(k == n, shingles_of(F.col("w"), n)) for n in range(width, 0, -1)])
    return (words.select("item", "item_id", k.alias("width"), F.explode(sets).alias("h")).distinct()
            .groupBy("item", "item_id", "width").agg(F.collect_list("h").alias("shingles")))


def document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    words = docs.select("doc_id", "text_hash", words_of(F.col("text")).alias("w"))
    parts = [F.coalesce(shingles_of(F.col("w"), n), F.array().cast("array<bigint>")) for n in widths]
    return words.select("doc_id", "text_hash", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Benchmark items (item_id, text) of which documents (doc_id, text) contain `percent` of the shingles or more.

    Returns doc_id, text_hash, item_id, item_shingles, matched, one row per pair.  Words
    are lower-cased runs between white space.  An item with fewer than `width` words is
    looked for as its whole sequence.  Null or empty texts contain nothing and are
    contained nowhere.  Repeated rows with equal id and text give one row; rows of one
    doc_id with different texts are told apart by text_hash, a null doc_id is an id like
    any other.  Every distinct (item_id, text) is an item of its own, a null item_id included;
    texts of one item_id that a document contains give a row each.  Empty tables give an empty result.  Other columns are ignored.
    """
    sets = materialize(item_sets(items, width), "bench-sets")
    facts = sets.agg(F.max(F.size("shingles")).alias("largest"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    parts = size_partitions(facts["largest"] or 1, percent)
    pick = lambda k: F.coalesce(*[F.when(F.size("shingles") <= p[0], F.lit(p[k])) for p in parts])
    ranked = F.array_sort(F.transform("shingles", lambda h: F.struct(F.xxhash64(h, F.lit(1)).alias("r"), h.alias("h"))))
    # an item in the first partition is sampled whole: its own size decides
    need = F.when(F.size("shingles") <= 16, F.ceil(F.size("shingles") * percent / 100).cast("int")).otherwise(pick(2))
    samples = materialize(sets.select("item", need.alias("need"),
                                      F.explode(F.slice(ranked, 1, pick(1))).alias("s"))
                          .select("item", "need", F.col("s.h").alias("h")), "bench-samples")
    asked = sized(samples)
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    widths = facts["widths"] or [width]
    hits = (document_shingles(texts, widths).join(asked, "h")
            .dropDuplicates(["doc_id", "text_hash", "item", "h"])
            .groupBy("doc_id", "text_hash", "item")
            .agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need")
            .select("doc_id", "text_hash", "item"))
    hits = materialize(hits, "bench-candidates")
    # only candidate documents are cut into shingles again
    found = sized(materialize(hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct(),
                              "bench-found"))
    again = texts.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi")
    one = F.struct("doc_id", "text_hash")  # a struct, since it compares nulls like values
    probes = document_shingles(again, widths).select(F.xxhash64(one).alias("key"), "doc_id", "text_hash", "h").distinct()
    wanted = (hits.join(sets, "item")
              .select(F.xxhash64(F.struct("doc_id", "text_hash")).alias("key"), "item", "item_id",
                      F.size("shingles").cast("long").alias("item_shingles"), F.explode("shingles").alias("h")))
    return (probes.join(wanted, ["key", "h"]).groupBy("doc_id", "text_hash", "item", "item_id")
            .agg(F.count(F.lit(1)).alias("matched"), F.max("item_shingles").alias("item_shingles"))
            .where(F.col("matched") * 100 >= F.col("item_shingles") * percent)
            .select("doc_id", "text_hash", "item_id", "item_shingles", "matched"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the rows whose text contains a benchmark item; all columns as they are, whatever their names."""
    id_, text = fresh("_bad", docs.columns), fresh("_bad_text", docs.columns)
    bad = sized(materialize(contained_items(docs, items, width, percent)
                            .select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text)).distinct(),
                            "bench-bad"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(text))
    return docs.join(bad, same, "left_anti")
