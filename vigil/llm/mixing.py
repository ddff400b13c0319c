"""Mixing sources to target weights, on DataFrame functions only.

Efraimidis-Spirakis sampling: every document gets an exponential key scaled by its
quality weight; inside a source, documents in the order of their keys are a weighted
sample without replacement, and a running sum of their sizes cuts it at the budget.
Whole epochs come first, the sample fills the fraction that is left.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import WORD, prefix_sums


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return ((F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5))
            / F.lit(float(2 ** 52)))


def water_level(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """Adds `target`: total shared by `weight`, at most cap * source_size each.

    A source is at its cap when the shared level reaches cap * size / weight.  Each
    round shares what the capped sources leave; a capped source stays capped, so the
    rounds end.  A round is one aggregate over the sources.
    """
    level, capped = 0.0, -1
    limit = F.col("source_size") * F.lit(cap)
    while True:
        full = F.col("weight") * F.lit(level) > limit
        row = sources.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("used"),
                          F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
                          F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == capped or not row["open"]:
            break
        level, capped = (total - row["used"]) / row["open"], row["n"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit).cast("double"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: place in code point order (null last), size, weight, target."""
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    # binary order is code point order; the place of a source is a running count of one
    keyed = per.select("source", "source_size", F.lit(0).alias("all"), F.lit(1).alias("one"),
                       F.col("source").isNull().alias("last"), F.col("source").cast("binary").alias("bytes"))
    placed = prefix_sums(keyed, "all", ["last", "bytes"], "one", "place")
    n = len(weights)
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int"))
    placed = materialize(placed.select("source", "source_size", "place", given.alias("weight")), "mix-places")
    return water_level(placed, float(total), cap)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, cap: float = 3.0,
        quality: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """Words that a mix takes of each document so that sources meet their target weights.

    `docs` has doc_id, text and source; `quality` has one positive weight per doc_id (none,
    null, zero or less: 1).  Texts are counted where they are read and never shuffled.  Returns doc_id, source, size (words), source_size, target,
    place, epochs (whole passes over the source), key, taken (words, repeats counted).
    The document on which a budget ends gives the words up to the budget.

    One row per input row, repeated rows and null ids included; ties of the key go by
    doc_id, then size.  A null source is a source, the last one.  Null or empty text has
    size 0 and gives nothing.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        given = quality.select(F.col("doc_id").alias("_rated"), F.col("weight").cast("double").alias("_weight"))
        rows = rows.join(given, F.col("doc_id") == F.col("_rated"), "left")
        weight = F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(F.lit(1.0))
    rows = rows.select("doc_id", "source", "size",
                       (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"))
    rows = materialize(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, cap)
    # sources are dealt by their place, a number without nulls
    placed = rows.withColumnRenamed("source", "own").join(
        targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    ordered = prefix_sums(placed, "place", ["key", "doc_id", "size"], "size", "before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (ordered.withColumn("epochs", epochs.cast("long"))
            .withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "place", "epochs", "key", "taken"))
