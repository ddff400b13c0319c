"""Small column-expression helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_2024_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z in microseconds


def pick(names: list[str], idx: Column) -> Column:
    """``names[idx % len(names)]`` as a native expression (no UDF)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]),
                        (idx % F.lit(len(names))).cast("int") + F.lit(1))


def ts_plus_ms(ts: Column, ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + (ms * F.lit(1000)).cast("long"))


def ts_from_2024_ms(ms: Column) -> Column:
    return F.timestamp_micros(F.lit(EPOCH_2024_US) + (ms * F.lit(1000)).cast("long"))


def epoch_s(ts: Column) -> Column:
    """Timestamp as fractional epoch seconds (double)."""
    return F.unix_micros(ts) / F.lit(1e6)


def rnd(c: Column, n: int = 0) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^n) / 10^n``.

    Spark's ``round`` rounds the *decimal text* of a double (0.82015 → 0.8202),
    while the monitored system and SQL engines round the binary value
    (0.82015 is 0.820149999… → 0.8201).  This keeps the binary rule.  A scaled value
    from 2^53 on is whole already and stays as it is (``floor`` gives a long).
    """
    m = float(10 ** n)
    x = c.cast("double")
    p = x * F.lit(m)
    whole = F.abs(p) >= F.lit(float(1 << 53))
    return F.when(whole, x).otherwise((F.signum(p) * F.floor(F.abs(p) + F.lit(0.5))) / F.lit(m))


def known(df, *columns: str):
    """``df`` with nulls in the key ``columns`` as 'unknown', so that their rows keep a key."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("unknown")))
    return df


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))
