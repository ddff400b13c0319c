"""Shared kernels for order-dependent operators that must stay parallel.

Rolling detectors are sequential per key, and a key may hold a third of all
rows.  A window partitioned by that key alone would be one task, so these
kernels cut each key into blocks that can run in parallel while staying exact:

* ``key_rank``     — exact 1-based rank of each row inside its key, computed
  from per-(key, coarse block) counts and a prefix sum over that small table.
* ``row_blocks``   — fixed-size row blocks by rank; the last ``overlap`` rows of
  each block are copied into the next block as read-only "ghost" rows, so a
  ``rowsBetween(-overlap, 0)`` frame inside (key, block) is exact.
* ``range_rank`` / ``sliding_count`` / ``first_in_window`` — exact positions
  in a range-partitioned global order (range partitioning samples the keys,
  so a hot key or a burst is spread over balanced partitions); sliding time
  counts and "oldest row in the window" become position differences and an
  equi-join on position.
* ``greedy_cooldown`` — greedy "fire only if ≥ cooldown since the last fire"
  suppression: blocks of a range-partitioned order become maps from the last
  fire before them to the last fire in them, which are composed in block order.
* ``exact_pick``   — exact order statistics (element at index i of the sorted
  column) without a global sort: value buckets from approximate quantiles,
  bucket counts, then a local sort of just the bucket that holds the index.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_rank(df: DataFrame, key: list[str], order: str, coarse: Column,
             out: str = "krank") -> DataFrame:
    """Add ``out`` = 1-based rank of ``order`` within ``key``.

    ``coarse`` must be monotone in ``order`` (e.g. ``floor(order / width)``);
    it splits a hot key into many window partitions.
    """
    d = df.withColumn("_cb", coarse)
    counts = d.groupBy(*key, "_cb").agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*key).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*key, "_cb", F.coalesce(F.sum("_n").over(wk), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*key, "_cb").orderBy(order))
    return (d.withColumn("_lr", local).join(offs, [*key, "_cb"])
            .withColumn(out, F.col("_off") + F.col("_lr")).drop("_cb", "_lr", "_off"))


def row_blocks(df: DataFrame, rank: str, block_rows: int, overlap: int) -> DataFrame:
    """Add ``blk`` and ``ghost``; ghost rows are copies of the ``overlap`` rows before a block.

    One pass: a row is repeated for every later block that still looks back on it.
    """
    r0 = F.col(rank) - 1
    own, last = F.floor(r0 / block_rows), F.floor((r0 + overlap) / block_rows)
    return (df.select("*", own.alias("_own"), F.explode(F.sequence(own, last)).alias("blk"))
            .withColumn("ghost", F.col("blk") != F.col("_own")).drop("_own"))


def exact_pick(vals: DataFrame, v: str, idx: dict[str, Column], buckets: int = 256) -> dict[str, Column]:
    """Scalar columns: for each name in ``idx``, the element at 0-based index
    ``idx[name]`` of ``vals[v]`` sorted ascending (exact; nulls excluded).

    Buckets come from approximate quantiles: values strictly between two bounds
    form an even bucket (about n / ``buckets`` rows), values equal to a bound
    form an odd, uniform bucket.  A uniform bucket answers directly (a hot
    value holding a third of all rows is never sorted); only the even bucket
    that holds the index is ranked.
    """
    probs = [k / buckets for k in range(1, buckets)]
    d = vals.select(F.col(v).alias("_v")).filter(F.col("_v").isNotNull())
    # bucket bounds: a fixed-size summary (buckets-1 doubles), fetched once
    row = d.agg(F.percentile_approx("_v", probs, 10_000).alias("b")).first()
    bounds = sorted(set(row["b"] or []))
    # binary search for the number of bounds below a value: the array is filled up to 2^k - 1
    size = 1
    while size <= len(bounds):
        size *= 2
    arr = F.array(*[F.lit(x) for x in bounds + [float("inf")] * (size - len(bounds))])
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())]) if size > 1 else F.array().cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(
        F.element_at(arr, at + step) < F.col("_v"), step).otherwise(0))
    d = d.withColumn("_lt", below).withColumn(
        "_bk", F.col("_lt") * 2 + (F.element_at(arr, F.col("_lt") + 1) == F.col("_v")).cast("int")).drop("_lt")
    counts = d.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"))
    w = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)  # ≤ 2·`buckets` rows
    offs = counts.select("_bk", "_n", "_mn", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    hit = None
    for i in idx.values():
        c = (F.col("_off") <= i) & (i < F.col("_off") + F.col("_n"))
        hit = c if hit is None else hit | c
    sel = offs.filter(hit)                                # at most len(idx) buckets
    ranked_bk = sel.filter(F.col("_bk") % 2 == 0).select("_bk", "_off")
    part = d.join(F.broadcast(ranked_bk), "_bk")
    local = part.withColumn(
        "_r", F.row_number().over(Window.partitionBy("_bk").orderBy("_v")) - 1 + F.col("_off"))
    picked = local.agg(*[F.max(F.when(F.col("_r") == i, F.col("_v"))).alias(name) for name, i in idx.items()])
    uniform = sel.filter(F.col("_bk") % 2 == 1).agg(*[
        F.max(F.when((F.col("_off") <= i) & (i < F.col("_off") + F.col("_n")), F.col("_mn"))).alias(name)
        for name, i in idx.items()])
    st = picked.select(F.struct(*idx.keys()).alias("s")).scalar()    # one scalar subquery each
    su = uniform.select(F.struct(*idx.keys()).alias("s")).scalar()
    return {name: F.coalesce(st.getField(name), su.getField(name)) for name in idx}


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  split_col: str | None = None) -> DataFrame:
    """Exact top-``n`` rows per key by ``order``; adds ``rank`` (1 = first).

    Spark limits the ranks before the exchange too, so at most ``n`` rows of a key
    leave each map task and a hot key is cut where it is read.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def running_count(df: DataFrame, key: str, order: str, flag: Column, coarse: Column,
                  out: str = "running") -> DataFrame:
    """Cumulative count of ``flag`` per key in ``order`` (inclusive), as a prefix
    sum over (key, coarse block) totals plus a running sum inside the block."""
    d = df.withColumn("_cb", coarse).withColumn("_f", flag.cast("long"))
    tot = d.groupBy(key, "_cb").agg(F.sum("_f").alias("_bt"))
    wp = Window.partitionBy(key).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select(key, "_cb", F.coalesce(F.sum("_bt").over(wp), F.lit(0)).alias("_p"))
    wl = Window.partitionBy(key, "_cb").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("_l", F.sum("_f").over(wl)).join(pre, [key, "_cb"])
            .withColumn(out, F.col("_p") + F.col("_l")).drop("_cb", "_f", "_l", "_p"))


# ---- exact parallel cooldown -----------------------------------------------------------

COOLDOWN_BLOCK = 200_000


def _grouped(batches, key: str):
    """((key, block), frame) of rows sorted by key and block; a group is at most one block."""
    import pandas as pd
    held: list = []
    for pdf in batches:
        new = (pdf[key] != pdf[key].shift()) | (pdf["_blk"] != pdf["_blk"].shift())
        cuts = [i for i, n in enumerate(new.tolist()) if n] + [len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            part = pdf.iloc[a:b]
            if held and (held[0][key].iloc[0], held[0]["_blk"].iloc[0]) != (part[key].iloc[0], part["_blk"].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def cooldown_map(times, cooldown: int):
    """(entries, exits) of a sorted block: a chain that starts at the first entry not before
    last fire + cooldown ends at its exit, the block's last fire.

    The last fire lies before the block, so only candidates within the cooldown of its first
    one, and the next, can start the chain; of entries with one exit the last is kept.
    """
    import numpy as np
    n = len(times)
    to = np.searchsorted(times, times + cooldown, "left")
    end = np.where(to < n, to, np.arange(n))
    while True:                                       # pointer doubling to the end of each chain
        further = end[end]
        if (further == end).all():
            break
        end = further
    entries = times[:int(np.searchsorted(times, times[0] + cooldown, "left")) + 1]
    exits = times[end][:len(entries)]
    kept = np.append(exits[1:] != exits[:-1], True)
    return entries[kept], exits[kept]


def greedy_cooldown(cands: DataFrame, key: str, ts: str, seq: str, cooldown_s: float, out: str = "fired",
                    block_rows: int = COOLDOWN_BLOCK) -> DataFrame:
    """Keep candidate rows that are ≥ cooldown after the key's last *fired* row; the
    first candidate of a key always fires.

    The candidates are cut into blocks of a range-partitioned order of (key, time, seq), so a
    key of any size is spread over tasks.  Every block but a key's last becomes a map from
    the last fire before it to the last fire in it (``cooldown_map``); composed in block
    order they give each block the last fire that it starts from.
    """
    import numpy as np

    from .materialize import materialize
    cd = int(round(cooldown_s * 1_000_000))
    # computed once: range partitioning samples its input
    cands = materialize(cands, "cooldown_candidates").withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = (range_rank(cands, [key, "_t", seq]).withColumn("_blk", F.floor(F.col("_pos") / block_rows))
            .drop("_pos"))
    last = rows.groupBy(key).agg(F.max("_blk").alias("_last"), F.min("_blk").alias("_first")).filter("_last > _first")
    inner = rows.select(key, "_blk", "_t").join(last.select(key, "_last"), key).filter(F.col("_blk") < F.col("_last"))

    def maps(batches):
        import pandas as pd
        for block in _grouped(batches, key):
            entries, exits = cooldown_map(block["_t"].to_numpy(), cd)
            yield pd.DataFrame({key: block[key].iloc[0], "_blk": block["_blk"].iloc[0], "_entry": entries, "_exit": exits})

    def compose(batches):
        import pandas as pd
        cur = fire = None
        for block in _grouped(batches, key):
            if block[key].iloc[0] != cur:
                cur, fire = block[key].iloc[0], None
            entries = block["_entry"].to_numpy()
            i = 0 if fire is None else int(np.searchsorted(entries, fire + cd, "left"))
            fire = int(block["_exit"].iloc[i]) if i < len(entries) else fire
            yield pd.DataFrame({key: [cur], "_blk": [block["_blk"].iloc[0] + 1], "_fire": [fire]})

    made = (inner.select(key, "_blk", "_t").repartition(key, "_blk").sortWithinPartitions(key, "_blk", "_t")
            .mapInPandas(maps, f"{key} string, _blk long, _entry long, _exit long"))
    starts = (made.repartition(key).sortWithinPartitions(key, "_blk", "_entry")
              .mapInPandas(compose, f"{key} string, _blk long, _fire long"))

    def fold(batches):
        for block in _grouped(batches, key):
            times, fire = block["_t"].to_numpy(), block["_fire"].iloc[0]
            to = np.searchsorted(times, times + cd, "left")
            fired = np.zeros(len(block), bool)
            i = int(np.searchsorted(times, fire + cd, "left")) if fire == fire and fire is not None else 0
            while i < len(times):                     # one step per fire
                fired[i] = True
                i = to[i]
            yield block.drop(columns=["_t", "_blk", "_fire"]).assign(**{out: fired})

    schema = T.StructType(cands.drop("_t").schema.fields + [T.StructField(out, T.BooleanType(), False)])
    seeded = rows.join(starts, [key, "_blk"], "left")
    names = [f.name for f in schema.fields[:-1]]
    return (seeded.select(*names, "_t", "_blk", "_fire").repartition(key, "_blk")
            .sortWithinPartitions(key, "_blk", "_t", seq).mapInPandas(fold, schema))


# ---- skew-robust exact ranks and sliding counts ---------------------------------------

_LOC_BITS = 33


def range_rank(df: DataFrame, order: list[str], flags: list[str] | None = None) -> DataFrame:
    """Exact global position of every row in ``order`` (a total order), without a
    single-partition sort: range partitioning samples the order keys, so a hot
    key is spread over many balanced partitions.  Adds ``_pos`` (0-based rank of
    all rows) and, for every 0/1 column ``f`` in ``flags``, ``_fpos_<f>`` = number
    of rows with f = 1 strictly before this row.  The ranked table is written
    once so that both passes see the same partitioning.
    """
    from .materialize import materialize
    flags = flags or []

    def before(batches):
        """Adds the number of rows before each in its partition that have each flag."""
        import numpy as np
        import pyarrow as pa
        so_far = dict.fromkeys(flags, 0)
        for batch in batches:
            for f in flags:
                own = np.asarray(batch.column(f).fill_null(0).cast(pa.int64()))
                upto = np.cumsum(own)
                batch = batch.append_column(f"_lb_{f}", pa.array(so_far[f] + upto - own))
                so_far[f] += int(upto[-1]) if len(upto) else 0
            yield batch

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    if flags:                                         # running counts inside balanced partitions, as they stand
        d = d.mapInArrow(before, T.StructType(d.schema.fields + [T.StructField(f"_lb_{f}", T.LongType()) for f in flags]))
    d = d.withColumn("_mid", F.monotonically_increasing_id())
    d = d.withColumn("_pid", F.shiftright("_mid", _LOC_BITS)) \
         .withColumn("_loc", F.col("_mid").bitwiseAND((1 << _LOC_BITS) - 1)).drop("_mid")
    d = materialize(d, "range_rank")
    per = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(f).alias(f"_pc_{f}") for f in flags])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)        # ≤ #partitions rows
    offs = per.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"),
                      *[F.coalesce(F.sum(f"_pc_{f}").over(w), F.lit(0)).alias(f"_po_{f}") for f in flags])
    out = d.join(F.broadcast(offs), "_pid").withColumn("_pos", F.col("_off") + F.col("_loc"))
    for f in flags:
        out = out.withColumn(f"_fpos_{f}", F.col(f"_po_{f}") + F.col(f"_lb_{f}"))
    return out.drop("_pid", "_loc", "_off", *[c for f in flags for c in (f"_lb_{f}", f"_po_{f}")])


def _sliding_count_ranked(df: DataFrame, keys: list[str], ts: str, seq: str, window_us: int,
                          out: str = "window_count", flag: str | None = None,
                          flag_out: str = "window_flagged") -> DataFrame:
    """For every row, the number of rows of its key with ts in [ts - window, ts]
    that come at or before it in (ts, seq) order — exact and skew-robust — and,
    with ``flag`` (a boolean column), how many of those are flagged.

    Lookup rows at ts - window are merged into the same global order (before
    data rows with an equal key and time), so each count is a difference of two
    positions among data rows.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    fl = F.col(flag).cast("int") if flag else F.lit(0)
    data = df.select(*keys, t.alias("_v"), F.lit(1).alias("_kind"), F.col(seq).alias("_s"), fl.alias("_flg"))
    look = df.select(*keys, (t - F.lit(window_us)).alias("_v"), F.lit(0).alias("_kind"),
                     F.col(seq).alias("_s"), F.lit(0).alias("_flg"))
    r = range_rank(data.unionByName(look), [*keys, "_v", "_kind", "_s"], flags=["_kind", "_flg"])
    at = r.filter(F.col("_kind") == 1).select(*keys, "_s", (F.col("_fpos__kind") + 1).alias("_upto"),
                                              (F.col("_fpos__flg") + F.col("_flg")).alias("_fupto"))
    lo = r.filter(F.col("_kind") == 0).select(*keys, "_s", F.col("_fpos__kind").alias("_below"),
                                              F.col("_fpos__flg").alias("_fbelow"))
    cols = [*keys, F.col("_s").alias(seq), (F.col("_upto") - F.col("_below")).alias(out)]
    if flag:
        cols.append((F.col("_fupto") - F.col("_fbelow")).alias(flag_out))
    cnt = at.join(lo, [*keys, "_s"]).select(*cols)
    return df.join(cnt, [*keys, seq])


def first_in_window(df: DataFrame, lookups: DataFrame, keys: list[str], ts: str, seq: str,
                    window_us: int, value: Column) -> DataFrame:
    """For every row of ``lookups``, ``_first`` = ``value`` of the oldest row of ``df`` with
    the same key and ts in [ts - window, ts], strictly before it in (ts, seq) order.
    Returns keys, seq, ``_first`` and ``_at`` (that row's microseconds ``_t`` and ``_s``, its seq)
    of the lookups that have one.

    Lookups at ts - window are merged into one range-partitioned order with the rows; the
    number of rows before a lookup is the position of the row wanted, fetched by an
    equi-join, so a hot key is spread over many tasks.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    data = df.select(*keys, t.alias("_v"), F.lit(1).alias("_kind"), F.col(seq).alias("_s"), value.alias("_first"))
    look = lookups.select(*keys, (t - F.lit(window_us)).alias("_v"), F.lit(0).alias("_kind"), F.col(seq).alias("_s"))
    r = range_rank(data.unionByName(look, allowMissingColumns=True), [*keys, "_v", "_kind", "_s"], flags=["_kind"])
    rows = r.filter(F.col("_kind") == 1).select(*keys, "_fpos__kind", F.struct(F.col("_v").alias("_t"), "_s").alias("_at"), "_first")
    asked = r.filter(F.col("_kind") == 0).select(*keys, "_fpos__kind", (F.col("_v") + F.lit(window_us)).alias("_t"), "_s")
    return (asked.join(rows, [*keys, "_fpos__kind"]).filter(F.col("_at") < F.struct("_t", "_s"))
            .select(*keys, F.col("_s").alias(seq), "_first", "_at"))


HOT_KEY_ROWS = 2_000_000     # keys with more rows than this are counted by position


def _split_hot(df: DataFrame, keys: list[str], hot_rows: int):
    """(cold rows, hot rows): keys with more than ``hot_rows`` rows are hot."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt")).filter(F.col("_cnt") > hot_rows).select(*keys)
    if hot.limit(1).count() == 0:
        return df, None
    return (df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi"))


def _cold_positions(df: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, flag: str | None):
    """Per-key window form: position in (ts, seq) order and the number of rows
    (and flagged rows) with ts < ts - window, exact with ties."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    d = df.withColumn("_tu", t)
    w_rows = Window.partitionBy(*keys).orderBy("_tu", seq).rowsBetween(Window.unboundedPreceding, 0)
    w_old = Window.partitionBy(*keys).orderBy("_tu").rangeBetween(Window.unboundedPreceding, -window_us - 1)
    d = d.withColumn("_pos1", F.count(F.lit(1)).over(w_rows)) \
         .withColumn("_old", F.coalesce(F.count(F.lit(1)).over(w_old), F.lit(0)))
    if flag:
        fl = F.col(flag).cast("int")
        d = d.withColumn("_fpos1", F.sum(fl).over(w_rows)) \
             .withColumn("_fold", F.coalesce(F.sum(fl).over(w_old), F.lit(0)))
    return d


def sliding_count(df: DataFrame, keys: list[str], ts: str, seq: str, window_us: int,
                  out: str = "window_count", flag: str | None = None, flag_out: str = "window_flagged",
                  hot_rows: int | None = None) -> DataFrame:
    """For every row, the number of rows of its key with ts in [ts - window, ts]
    at or before it in (ts, seq) order (and, with ``flag``, how many are
    flagged).  Keys up to ``hot_rows`` rows use one per-key window; hot keys
    and the unkeyed case use exact positions in a range-partitioned order."""
    limit = HOT_KEY_ROWS if hot_rows is None else hot_rows
    if not keys:
        return _sliding_count_ranked(df, keys, ts, seq, window_us, out, flag, flag_out)
    cold, hot = _split_hot(df, keys, limit)
    d = _cold_positions(cold, keys, ts, seq, window_us, flag)
    d = d.withColumn(out, F.col("_pos1") - F.col("_old"))
    if flag:
        d = d.withColumn(flag_out, F.col("_fpos1") - F.col("_fold"))
    d = d.drop("_tu", "_pos1", "_old", "_fpos1", "_fold")
    if hot is None:
        return d
    return d.unionByName(_sliding_count_ranked(hot, keys, ts, seq, window_us, out, flag, flag_out))
