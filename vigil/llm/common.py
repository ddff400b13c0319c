"""Helpers shared by the operators of this package."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize

WORD = r"[^\x20\x09-\x0D]+"


def crc_rest(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def held_out(doc_id: Column, n: int, rest: int) -> Column:
    """True where the crc remainder is `rest`; a row without an id is never learned from."""
    return F.coalesce(crc_rest(doc_id, n) == F.lit(rest), F.lit(True))


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column in `taken` has it (in any case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def salted_lookup(left: DataFrame, table: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Left join of `left` to `table` (one row per key) where one key may hold a third of `left`.

    Every key is dealt over `salts` parts: the table's rows are repeated for each
    part, the left rows get a part by their content.  Null keys match nothing.
    """
    own = [c for c in left.columns]
    part = F.pmod(F.xxhash64(*[F.col(c) for c in own]), F.lit(salts)).cast("int")
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (left.withColumn("_salt", part)
            .join(many, keys + ["_salt"], "left").drop("_salt"))


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str, parts: int = 0) -> DataFrame:
    """Sum of `value` over the rows before each row of its group, in the given order.

    The rows are dealt by ranges of (group, order), so a group with a third of all
    rows is spread over many tasks.  What a range holds of a group is added up in a
    small table (at most ranges + groups rows), whose running sums give each range
    its start.  The dealt rows are written once: the ranges must not change between
    the two passes.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.repartitionByRange(parts, F.col(group), *[F.col(c) for c in order])
             .withColumn("_range", F.spark_partition_id()))
    dealt = materialize(dealt, "prefix")
    starts = (dealt.groupBy(group, "_range").agg(F.sum(value).alias("_held"))
              .withColumn("_start", F.expr(
                  f"sum(_held) over (partition by {group} order by _range) - _held"))
              .drop("_held"))
    inside = F.expr(f"sum({value}) over (partition by {group}, _range order by {', '.join(order)} "
                    f"rows between unbounded preceding and current row) - {value}")
    return (dealt.withColumn("_inside", inside)
            .join(starts, [group, "_range"])
            .withColumn(out, F.col("_inside") + F.col("_start"))
            .drop("_inside", "_start", "_range"))


#: Tables of a few numbers per row are broadcast up to this many rows (some tens of MB).
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The written table `df`, to be broadcast if it has at most `limit` rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= limit else df


def pieces(n: int, size: int) -> int:
    """How many pieces of at most about `size` hold n rows."""
    return max(1, math.ceil(n / size))


TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """Has the session send whole texts to Python workers at most TEXT_ROWS at a time.

    Spark's own 10000 rows hold tens of MB of text on either side of each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    from ..sources.tables import table
    t = table(spark, sf_dir, name)
    return t.select(*columns) if columns else t
