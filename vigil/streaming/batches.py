"""Streaming detectors as batch kernels per micro-batch.

``foreachBatch`` runs the batch operators over the micro-batch and the rows carried from
the one before, so a gateway, user or service is cut into blocks as it is in batch and no
key is one group.  Carried are only rows that a later row can still look back on, running
totals per key, and the last fire per cooldown key; ``lateness_s`` keeps time windows
whole for rows that arrive that much late.

A batch reads the state of the batch before it and overwrites its own output and state
folders, so a batch that is run again after a failure or a restart leaves one result.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import known, rnd
from ..functions.constants import PAY_TUNING, PII_COOLDOWN_S, PII_THRESHOLD, PII_WINDOW_S
from ..functions.redaction import is_redacted
from ..operators import logs as LG
from ..operators import payments_detect as PD
from ..operators import traces as TR
from ..plans.materialize import materialize, passing_tables
from ..plans.ordered import greedy_cooldown, range_rank, top_n_per_key
from ..session import passing_shuffles, remove
from ..sources import otlp as OT

#: Rows of a step: one table, or several by name.
Rows = DataFrame | dict[str, DataFrame]
#: (micro-batch, carried tables or {} on the first) → (result rows, tables to carry)
Step = Callable[[DataFrame, dict[str, DataFrame]], tuple[Rows, dict[str, DataFrame]]]


def start_fold(stream: DataFrame, step: Step, tables: list[str], folder: str, available_now: bool = True):
    """Start the stream; results go to ``folder``/out, one sub-folder per micro-batch (and per named table).

    What a batch has landed, shuffled and written in between is removed at its end, and the state
    before the last committed batch's (S10): a batch that runs again needs the state of the batch
    before it only.
    """
    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        remove(spark, f"{folder}/state/{batch_id - 2}")
        landed = f"{folder}/landed/{batch_id}"      # the kernels read the batch several times
        with passing_shuffles(spark), passing_tables(spark):
            batch.write.mode("overwrite").option("compression", "zstd").parquet(landed)
            carried = {t: spark.read.parquet(f"{folder}/state/{batch_id - 1}/{t}") for t in tables} if batch_id else {}
            rows, carry = step(spark.read.schema(batch.schema).parquet(landed), carried)
            for t in tables:
                carry[t].write.mode("overwrite").parquet(f"{folder}/state/{batch_id}/{t}")
            for name, df in rows.items() if isinstance(rows, dict) else [("", rows)]:
                df.write.mode("overwrite").parquet(f"{folder}/out/{name}/batch={batch_id}" if name else f"{folder}/out/batch={batch_id}")
        remove(spark, landed)

    w = stream.writeStream.option("checkpointLocation", f"{folder}/_checkpoint").foreachBatch(sink)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _with_carried(batch: DataFrame, carried: dict[str, DataFrame], name: str) -> DataFrame:
    return batch.unionByName(carried[name]) if carried else batch


def _recent(rows: DataFrame, seconds: float) -> DataFrame:
    """Rows at most ``seconds`` older than the newest row."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.filter(us >= rows.agg(F.max(us)).scalar() - int(seconds * 1_000_000))


def _cooled(cands: DataFrame, fires: DataFrame | None, key: str, cooldown_s: float) -> tuple[DataFrame, DataFrame]:
    """(fired candidates, last fire of each key): the carried last fire is the key's first candidate."""
    if fires is not None:
        cands = (cands.join(fires.select(key, F.col("ts").alias("_last")), key, "left")
                 .filter(F.col("_last").isNull() | (F.col("ts") >= F.col("_last"))).drop("_last")
                 .withColumn("_seed", F.lit(False))
                 .unionByName(fires.withColumn("_seed", F.lit(True)), allowMissingColumns=True))
    else:
        cands = cands.withColumn("_seed", F.lit(False))
    fired = greedy_cooldown(cands, key, "ts", "seq", cooldown_s).filter("fired")
    last = (fired.groupBy(key).agg(F.max(F.struct("ts", "seq")).alias("_f"))
            .select(key, F.col("_f.ts").alias("ts"), F.col("_f.seq").alias("seq")))
    return fired.filter(~F.col("_seed")), last


def rolling_p99_step(batch: DataFrame, carried: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """p99 of each gateway's last 300 latencies; carries the last 299 payments of a gateway."""
    own = known(batch.select("gateway", "seq", "ts", "latency_ms"), "gateway").withColumn("own", F.lit(True))
    rows = _with_carried(own, carried, "tail")
    out = PD.rolling_p99(rows, keep=("own",)).filter("own").drop("own")
    tail = top_n_per_key(rows, ["gateway"], [F.desc("seq")], PAY_TUNING["p99_memory"] - 1)
    return out, {"tail": tail.drop("rank").withColumn("own", F.lit(False))}


def payment_alerts_step(lateness_s: float = 600) -> Step:
    """The four payment detectors and their cooldown.

    Carries the last 11 payments of a gateway, the payments of the last 120 s (the longest
    look back of a user) and the last fire per detector and target.
    """
    def step(batch, carried):
        rows = _with_carried(known(batch, "gateway", "user"), carried, "rows")
        cands = PD.payment_alert_candidates(rows).join(batch.select("seq"), "seq", "left_semi")
        fired, last = _cooled(cands, carried.get("fires"), "cooldown_key", PAY_TUNING["refire_cooldown_s"])
        tail = top_n_per_key(rows, ["gateway"], [F.desc("seq")], PAY_TUNING["fail_window"] - 1).drop("rank")
        keep = tail.unionByName(_recent(rows, PAY_TUNING["dup_window_s"] + lateness_s)).dropDuplicates(["seq"])
        return fired.select(*PD.ALERT_COLS), {"rows": keep, "fires": last}
    return step


def trace_detectors_step(batch: DataFrame, carried: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """R4 + R5: N+1 and bimodal flags of closed traces, each judged before it is learned from.

    Carries the span-count totals of a service and the mean and variance of its EWMA.
    """
    cols = ["trace_id", "trace_seq", "primary_service", "span_count", "duration_ms"]
    own = known(batch.select(*cols), "primary_service")
    totals, ewma = carried.get("totals"), carried.get("ewma")
    spans = TR.n_plus_1(own, before=totals).select("trace_seq", "n_plus_1")
    latency = TR.bimodal(own, before=ewma).select(*cols, "bimodal_latency", "latency_variance")
    state = TR.ewma_state(own, before=ewma)
    if ewma is not None:  # services without a trace in this batch
        state = state.unionByName(ewma.join(state.select("primary_service"), "primary_service", "left_anti"))
    return latency.join(spans, "trace_seq"), {"totals": TR.span_totals(own, before=totals), "ewma": state}


TRACE_TABLES = ["totals", "ewma"]


def trace_alerts_step(lateness_s: float = 60, window_s: int = 10) -> Step:
    """R1 + R2 + R4 + M13: spans → closed windows → traces → detectors → alerts.

    A window closes once a span at least ``lateness_s`` after its end has arrived; its traces
    are numbered in (window, trace) order behind all earlier ones.  Spans of a window that
    was closed before they came are late; they and spans without a start time are left out
    and counted: the ``balance`` table has a row per micro-batch of how many spans came in,
    left in a closed window, came late, had no time, and wait in open windows.
    Carries the spans of open windows, the newest time seen and the detectors' state.
    """
    end = F.window("start_time", f"{window_s} seconds")["end"]

    def step(batch, carried):
        own = batch.filter("start_time is not null").withColumn("window_end", end)
        clock = own.agg(F.max("start_time").alias("newest"), F.lit(0).cast("long").alias("numbered"))
        timely = F.lit(True)
        if carried:
            before = carried["clock"].first()            # one row: the time and the number reached
            if before["newest"] is not None:
                late_to = F.lit(before["newest"]).cast("timestamp") - F.expr(f"INTERVAL {lateness_s} SECONDS")
                timely = F.col("window_end") > late_to
            clock = clock.unionByName(carried["clock"]).agg(F.max("newest").alias("newest"),
                                                            F.max("numbered").alias("numbered"))
        came = (batch.agg(F.count(F.lit(1)).alias("spans_in"), F.count_if(F.col("start_time").isNull()).alias("timeless"))
                .unionByName(own.agg(F.count_if(~timely).alias("late")), allowMissingColumns=True))
        own = own.filter(timely)
        if carried:
            own = own.unionByName(carried["open"])
        newest, numbered = clock.first()
        newest = F.lit(newest).cast("timestamp")
        closed = F.coalesce(F.col("window_end") <= newest - F.expr(f"INTERVAL {lateness_s} SECONDS"), F.lit(False))
        went = own.agg(F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"))
        balance = (came.unionByName(went, allowMissingColumns=True)
                   .agg(*[F.max(c).alias(c) for c in ("spans_in", "closed", "late", "timeless", "open")]))
        spans = own.filter(closed).drop("window_end")
        # dealt by the trace, spans are shuffled once; written before ranking, which samples its input, traces are built once
        traces = TR.build_traces(spans.repartition("trace_id"), window_s=window_s).withColumn("window_start", F.col("window.start"))
        ranked = range_rank(materialize(traces.drop("window"), "closed-traces"), ["window_start", "trace_id"])
        ranked = ranked.withColumn("trace_seq", F.col("_pos") + F.lit(numbered)).drop("_pos")
        flags, state = trace_detectors_step(ranked, {t: carried[t] for t in TRACE_TABLES} if carried else {})
        verdicts = TR.verdicts(ranked.join(flags.select("trace_seq", "n_plus_1", "bimodal_latency", "latency_variance"),
                                           "trace_seq"))
        alerts = TR.trace_alerts(verdicts, keep=("window_start",))
        now = ranked.agg(newest.alias("newest"), (F.count(F.lit(1)) + F.lit(numbered)).alias("numbered"))
        return {"alerts": alerts, "balance": balance}, {"open": own.filter(~closed), "clock": now, **state}
    return step


ALERT_TABLES = ["open", "clock", *TRACE_TABLES]


def telemetry_step(pii_threshold: float = PII_THRESHOLD, lateness_s: float = 60, window_s: int = 10) -> Step:
    """S1 + S3 → R1–R5: one micro-batch of decoded messages forked to spans and logs.

    Spans go to ``trace_alerts_step``, logs to ``pii_alerts_step`` (numbered in (ts, span id)
    order behind all earlier ones); messages that can't be decoded are counted by reason in
    the ``dead`` table.  ``alerts`` holds both kinds of alerts.
    """
    traces, pii = trace_alerts_step(lateness_s, window_s), pii_alerts_step(pii_threshold)

    def step(batch, carried):
        good = batch.filter("reason is null")
        start = F.when(F.col("start_time") > F.timestamp_seconds(F.lit(0)), F.col("start_time"))
        spans = OT.flatten_spans(good).select(
            "trace_id", "span_id", "parent_span_id", F.col("service_name").alias("service"),
            F.col("span_name").alias("name"), "duration_ms", start.alias("start_time"), "status_code")
        # read in several passes below: messages are flattened once
        out, state = traces(materialize(spans, "flat-spans"), {t: carried[t] for t in ALERT_TABLES} if carried else {})
        # whole texts are neither dealt nor written again: what is asked of them is whether they are redacted
        logs = OT.flatten_logs(good, "ingest_ts").select(
            "trace_id", "span_id", "service_name", F.col("timestamp").alias("ts"), is_redacted(F.col("body")).alias("is_redacted"))
        logs = range_rank(logs, ["ts", "span_id"])
        reached = carried["lines"].first()["lines"] if carried else 0  # one row
        logs = logs.withColumn("seq", F.col("_pos") + F.lit(reached)).drop("_pos")
        fired, held = pii(logs, {t: carried[t] for t in ("rows", "fires")} if carried else {})
        lines = logs.agg((F.count(F.lit(1)) + F.lit(reached)).alias("lines"))
        alerts = out["alerts"].select(
            F.lit("trace").alias("kind"), "service", "trace_id", F.col("window_start").alias("at"), "anomaly_type",
            F.concat_ws(",", "reasons").alias("reasons"), F.lit(None).cast("double").alias("ratio"))
        alerts = alerts.unionByName(fired.select(
            F.lit("log").alias("kind"), "service", "trace_id", F.col("ts").alias("at"),
            F.lit("PII Redaction Density").alias("anomaly_type"), F.lit("pii_redaction_density").alias("reasons"), "ratio"))
        dead = batch.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))
        return ({"alerts": alerts, "balance": out["balance"], "dead": dead},
                {**state, **held, "lines": lines})
    return step


TELEMETRY_TABLES = [*ALERT_TABLES, "rows", "fires", "lines"]


def real_only_step(batch: DataFrame, carried: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Simulated payments are left out from the first live one on; carries its time (one row, latched)."""
    first = batch.filter(F.col("source") == "live").agg(F.min("ts").alias("first_live"))
    if carried:
        first = first.unionByName(carried["latch"]).agg(F.min("first_live").alias("first_live"))
    at = first.select("first_live").scalar()
    return batch.filter((F.col("source") == "live") | at.isNull() | (F.col("ts") < at)), {"latch": first}


def late_rows_step(allowed_s: float, ts: str = "ts") -> Step:
    """R2: rows that came more than ``allowed_s`` behind the newest row of earlier micro-batches."""
    def step(batch, carried):
        clock = batch.agg(F.max(ts).alias("newest"))
        if not carried:
            return batch.limit(0), {"clock": clock}
        seen = carried["clock"]
        late = batch.filter(F.col(ts) < seen.select("newest").scalar() - F.expr(f"INTERVAL {allowed_s} SECONDS"))
        return late, {"clock": clock.unionByName(seen).agg(F.max("newest").alias("newest"))}
    return step


def redaction_counter_step(batch: DataFrame, carried: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Running redaction count per service; carries each service's total."""
    logs = known(batch, "service_name").withColumn("is_redacted", is_redacted(F.col("body")))
    counts = LG.redaction_counter(logs)
    totals = logs.groupBy("service_name").agg(F.sum(F.col("is_redacted").cast("long")).alias("total"))
    if carried:
        before = carried["totals"]
        counts = (counts.join(before.withColumnRenamed("service_name", "service"), "service", "left")
                  .withColumn("value", F.col("value") + F.coalesce("total", F.lit(0))).drop("total"))
        totals = totals.unionByName(before).groupBy("service_name").agg(F.sum("total").alias("total"))
    return counts.select("service", "seq", "value"), {"totals": totals}


def pii_alerts_step(threshold: float = PII_THRESHOLD, lateness_s: float = 600) -> Step:
    """PII density alerts; carries the flags of the last 60 s and each service's last fire."""
    def step(batch, carried):
        flag = F.col("is_redacted") if "is_redacted" in batch.columns else is_redacted(F.col("body"))
        own = known(batch, "service_name").select("seq", "service_name", "trace_id", "ts", flag.alias("is_redacted"))
        rows = _with_carried(own, carried, "rows")
        cands = LG.pii_density(rows, threshold=threshold).join(own.select("seq"), "seq", "left_semi")
        fired, last = _cooled(cands, carried.get("fires"), "service_name", PII_COOLDOWN_S)
        out = fired.select(F.col("service_name").alias("service"), "trace_id", "ts", "seq",
                           rnd(F.col("redaction_ratio"), 6).alias("ratio"), "window_log_count", "redacted_count")
        return out, {"rows": _recent(rows, PII_WINDOW_S + lateness_s), "fires": last}
    return step
