"""Connected components of a link table by smallest labels with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import few_files


def connected(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in `links` (a, b): comp is the smallest id that it reaches.

    Every round gives an id the smallest label among its neighbours and then its label's
    label, so chains are halved; the rounds end when no label changes.  Labels are
    written each round.  What an id hears from its neighbours is aggregated before it is
    shuffled; looking up the labels is a plain join, whose rows of an id with very many
    links Spark's adaptive skew join splits.  No links give an empty result.
    """
    both = few_files(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct(), "links")
    label = few_files(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                        .select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = (both.join(label.select(F.col("id").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near")))
        low = (label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("low")))
        jump = label.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = few_files(low.join(jump, "low", "left")
                          .select("id", "old", F.least("low", F.coalesce("far", "low")).alias("comp")), "labels")
        if new.where("old <> comp").isEmpty():
            return new.select("id", "comp")
        label = new.select("id", "comp")
