"""Ingest-shaped views: OTLP/JSON messages packed from the span / log / metric
views, plus malformed messages taken from the documents table.

Packing uses ``to_json`` over bounded groups (the spans of one trace and
service), so the messages grow with the driver tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import EPOCH_2024_US, rnd
from ..sources.tables import table
from .vehicles import v_log, v_metric, v_span

INGEST_TS = "2024-06-01 00:00:00"


def _kv(key, value_struct):
    return F.struct(F.lit(key).alias("key"), value_struct.alias("value"))


def _service_resource(svc):
    return F.struct(F.array(_kv("service.name", F.struct(svc.alias("stringValue")))).alias("attributes"))


def otlp_trace_messages(spark: SparkSession, sf_dir: str, spans: DataFrame | None = None) -> DataFrame:
    """A message per (trace, service); ``at`` is its first span's start."""
    s = v_span(spark, sf_dir) if spans is None else spans
    start_ns = F.unix_micros(F.col("start_time")) * 1000
    end_ns = start_ns + rnd(F.col("duration_ms") * 1e6).cast("long")
    def val(sv, iv):
        return F.struct(sv.cast("string").alias("stringValue"), iv.cast("string").alias("intValue"))
    none = F.lit(None)
    route_attr = (F.when(F.col("rn") % 3 == 0, F.array(_kv("http.route", val(
                      F.concat(F.lit("/r/"), F.col("name")), none))))
                  .when(F.col("rn") % 3 == 1, F.array(_kv("http.route", val(none, F.lit("7")))))
                  .otherwise(F.array().cast("array<struct<key:string,value:struct<stringValue:string,"
                                            "intValue:string>>>")))
    parent = F.when((F.col("parent_span_id") == "") & (F.col("rn") % 2 == 0), F.lit(None).cast("string")) \
              .otherwise(F.col("parent_span_id"))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), parent.alias("parentSpanId"),
        F.lit(1).alias("flags"), F.col("name").alias("name"), F.lit(2).alias("kind"),
        start_ns.cast("string").alias("startTimeUnixNano"), end_ns.cast("string").alias("endTimeUnixNano"),
        route_attr.alias("attributes"),
        F.struct(F.when(F.col("status_code") != 0, F.col("status_code")).alias("code")).alias("status"))
    # spans are dealt by trace_seq already, of which the trace id is the text
    g = s.groupBy("trace_seq", "trace_id", "service").agg(F.collect_list(span).alias("spans"), F.min("start_time").alias("at"))
    msg = F.struct(F.array(F.struct(
        _service_resource(F.col("service")).alias("resource"),
        F.array(F.struct(F.struct(F.lit("vigil").alias("name")).alias("scope"), F.col("spans").alias("spans")))
        .alias("scopeSpans"))).alias("resourceSpans"))
    return g.select(F.to_json(msg).alias("payload"), "at")


def otlp_log_messages(spark: SparkSession, sf_dir: str, timeless: bool = True) -> DataFrame:
    """A message per log, at its time; with ``timeless``, one in 50 does not name it."""
    lg = v_log(spark, sf_dir)
    seq = F.col("seq")
    known = (F.unix_micros(F.col("ts")) * 1000).cast("string")
    ns = F.when(seq % 50 == 0, F.lit("0")).otherwise(known) if timeless else known
    rec = F.struct(
        ns.alias("timeUnixNano"), F.lit(9).alias("severityNumber"),
        F.when(seq % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("severity")).alias("severityText"),
        F.struct(F.col("body").alias("stringValue")).alias("body"),
        F.when(seq % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("trace_id")).alias("traceId"),
        F.col("span_id").alias("spanId"))
    msg = F.struct(F.array(F.struct(
        _service_resource(F.col("service_name")).alias("resource"),
        F.array(F.struct(F.struct(F.lit("logs").alias("name")).alias("scope"),
                         F.array(rec).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return lg.select(F.to_json(msg).alias("payload"), F.col("ts").alias("at"))


def otlp_metric_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v_metric(spark, sf_dir)
    point = F.struct(F.col("value").alias("asDouble"),
                     (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"))
    msg = F.struct(F.array(F.struct(
        _service_resource(F.col("service")).alias("resource"),
        F.array(F.struct(F.array(F.struct(F.col("metric_type").alias("name"),
                                          F.struct(F.array(point).alias("dataPoints")).alias("sum")))
                         .alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return m.select(F.to_json(msg).alias("payload"))


def junk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One undecodable message per document: its text, nothing, or JSON that is no object."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 3
    return d.select(
        F.when(k == 0, F.col("text")).when(k == 1, F.lit(""))
         .otherwise(F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))).alias("payload"), "doc_id")


def v_otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of the multiplexed telemetry stream, with an ingestion time."""
    u = (otlp_trace_messages(spark, sf_dir).drop("at").unionByName(otlp_log_messages(spark, sf_dir).drop("at"))
         .unionByName(otlp_metric_messages(spark, sf_dir)).unionByName(junk_messages(spark, sf_dir).drop("doc_id")))
    # messages land as raw text (the queue); parsing always starts from storage
    from .materialize import materialize
    return materialize(u.withColumn("ingest_ts", F.lit(INGEST_TS).cast("timestamp")), "v_otlp")


def v_live_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all traces on one clock: a trace starts 200 ms after the one before it."""
    at = F.timestamp_micros(F.lit(EPOCH_2024_US) + F.col("trace_seq") * 200_000 + F.col("rn") * 10_000)
    return v_span(spark, sf_dir).withColumn("start_time", at)


def v_otlp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live telemetry stream as (line, at): traces, logs, metrics and undecodable lines on one clock."""
    metrics = otlp_metric_messages(spark, sf_dir).withColumn("at", F.timestamp_micros(F.lit(EPOCH_2024_US)))
    junk = junk_messages(spark, sf_dir).select(
        F.translate("payload", "\n\r", "  ").alias("payload"),
        F.timestamp_micros(F.lit(EPOCH_2024_US) + F.col("doc_id") * 100_000).alias("at"))
    u = (otlp_trace_messages(spark, sf_dir, v_live_span(spark, sf_dir))
         .unionByName(otlp_log_messages(spark, sf_dir, timeless=False)).unionByName(metrics).unionByName(junk))
    return u.select(F.col("payload").alias("line"), "at")


# ---- webhook deliveries -----------------------------------------------------------

# FIXED VALUES (test secrets for the landed-webhook view; JUSPAY is left unconfigured)
HOOK_SECRETS = {"RAZORPAY": "rzp_test_secret", "STRIPE": "whsec_test", "PHONEPE": "phonepe-salt",
                "CASHFREE": "cf_secret", "PAYU": "payu_salt", "CCAVENUE": "x" * 80}
HOOK_INGEST_KEY = "ingest-key"
ENDPOINTS = ["razorpay", "stripe", "phonepe", "cashfree", "payu", "gateway/ccavenue", "gateway/juspay", "ingest"]


def v_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gateway-shaped webhook deliveries built from the transactions view.

    endpoint = seq % 8; every 13th delivery is signed with a wrong secret and
    every 9th Razorpay / Stripe event is of an unknown type.
    """
    from ..sources.webhooks import hmac_sha256_b64, hmac_sha256_hex
    from .vehicles import v_txn
    t = v_txn(spark, sf_dir)
    seq = F.col("seq")
    e = seq % 8
    bad = seq % 13 == 0
    unknown = seq % 9 == 0
    created = F.floor(F.unix_micros(F.col("ts")) / 1_000_000).cast("long")
    cents = rnd(F.col("amount") * 100).cast("long")
    email = F.concat(F.col("user"), F.lit("@example.com"))
    m, st, tt = F.col("method"), F.col("status"), F.col("txn_type")
    refund = tt == "REFUND"

    def sec(k):
        return F.lit(HOOK_SECRETS[k])

    # Razorpay
    rz_code = (F.when(m == "UPI", "upi").when(m == "CREDIT_CARD", "card").when(m == "NET_BANKING", "netbanking")
               .when(m == "WALLET", "wallet").when(m == "BNPL", "emi").when(m == "BANK_TRANSFER", "bank_transfer")
               .otherwise("debit"))
    rz_event = (F.when(unknown, "payment.dispute.created")
                .when(refund, F.when(st == "FAILED", "refund.failed").otherwise("refund.processed"))
                .when(st == "SUCCESS", "payment.captured").when(st == "PENDING", "payment.authorized")
                .otherwise("payment.failed"))
    rz_body = F.to_json(F.struct(
        rz_event.alias("event"), created.alias("created_at"),
        F.struct(
            F.struct(F.struct(
                F.col("txn_id").alias("id"), F.col("order_id").alias("order_id"), rz_code.alias("method"),
                F.when(m == "UPI", F.concat(F.col("user"), F.lit("@okaxis"))).alias("vpa"),
                cents.alias("amount"), F.lower("currency").alias("currency"),
                (created - F.floor(F.col("latency_ms") / 1000).cast("long")).alias("created_at"),
                F.col("failure_reason").alias("error_code"), email.alias("email")).alias("entity")).alias("payment"),
            F.when(refund, F.struct(F.struct(
                F.concat(F.lit("rf"), F.col("txn_id")).alias("id"), F.col("order_id").alias("order_id"),
                cents.alias("amount"), F.lower("currency").alias("currency")).alias("entity"))).alias("refund")
        ).alias("payload")))
    # Stripe
    st_type = (F.when(unknown, "customer.created").when(refund & (st == "SUCCESS"), "charge.refunded")
               .when(st == "SUCCESS", "payment_intent.succeeded").when(st == "PENDING", "payment_intent.processing")
               .otherwise("payment_intent.payment_failed"))
    pm = (F.when(m == "UPI", "upi").when(m == "NET_BANKING", "netbanking").when(m == "WALLET", "wallet")
          .otherwise("card"))
    is_chg_ref = refund & (st == "SUCCESS")
    st_body = F.to_json(F.struct(st_type.alias("type"), F.struct(F.struct(
        F.col("txn_id").alias("id"), F.array(pm).alias("payment_method_types"),
        F.create_map(F.lit("order_id"), F.col("order_id")).alias("metadata"),
        F.when(~is_chg_ref, cents).alias("amount"), F.when(is_chg_ref, cents).alias("amount_refunded"),
        F.lower("currency").alias("currency"), email.alias("receipt_email"),
        F.when(st == "FAILED", F.struct(F.col("failure_reason").alias("code"))).alias("last_payment_error")
    ).alias("object")).alias("data")))
    st_t = created.cast("string")
    # PhonePe
    pp_state = F.when(st == "SUCCESS", "COMPLETED").otherwise(st)
    pp_inner = F.to_json(F.struct(F.struct(
        pp_state.alias("state"), F.col("txn_id").alias("transactionId"),
        F.col("order_id").alias("merchantTransactionId"), cents.alias("amount"),
        F.concat(F.lit("98765"), F.lpad((seq % 100000).cast("string"), 5, "0")).alias("mobileNumber")
    ).alias("data")))
    pp_b64 = F.base64(pp_inner.cast("binary"))
    pp_body = F.to_json(F.struct(pp_b64.alias("response")))
    pp_idx = F.when(seq % 2 == 0, F.lit("2")).otherwise(F.lit("1"))
    # Cashfree
    cf_group = (F.when(m == "UPI", "upi").when(m == "CREDIT_CARD", "card").when(m == "NET_BANKING", "netbanking")
                .when(m == "WALLET", "app").otherwise("paylater"))
    cf_body = F.to_json(F.struct(F.struct(
        F.struct(F.col("txn_id").alias("cf_payment_id"), st.alias("payment_status"), cf_group.alias("payment_group"),
                 F.col("amount").alias("payment_amount"),
                 F.struct(F.col("failure_reason").alias("error_reason")).alias("error_details")).alias("payment"),
        F.struct(F.col("order_id").alias("order_id"), F.col("amount").alias("order_amount"),
                 F.col("currency").alias("order_currency")).alias("order")).alias("data")))
    # PayU (form post)
    pu_mode = (F.when(m == "UPI", "UPI").when(m == "CREDIT_CARD", "CC").when(m == "DEBIT_CARD", "DC")
               .when(m == "NET_BANKING", "NB").when(m == "WALLET", "CASH").otherwise("EMI"))
    pu_status = F.when(st == "SUCCESS", "success").when(st == "PENDING", "pending").otherwise("failure")
    amt_txt = F.format_string("%.2f", F.col("amount"))
    pu_fields = [("key", F.lit("merchant")), ("txnid", F.col("order_id")), ("amount", amt_txt),
                 ("productinfo", F.lit("order")), ("firstname", F.lit("user")), ("email", email),
                 ("status", pu_status), ("mihpayid", F.col("txn_id")), ("mode", pu_mode),
                 ("error_Message", F.coalesce(F.col("failure_reason"), F.lit("")))]
    pu_salt = F.when(bad, F.lit("wrong")).otherwise(sec("PAYU"))
    pu_hash = F.sha2(F.concat_ws("|", pu_salt, pu_status, *[F.lit("")] * 5, *[F.lit("")] * 5, email,
                                 F.lit("user"), F.lit("order"), amt_txt, F.col("order_id"),
                                 F.lit("merchant")).cast("binary"), 512)
    pu_body = F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in pu_fields],
                          F.concat(F.lit("hash="), pu_hash))
    # universal / ingest (normalised JSON)
    uni_body = F.to_json(F.struct(
        F.col("txn_id"), F.col("order_id"), F.col("txn_type"), F.col("method"), F.col("provider"),
        F.when(seq % 2 == 1, F.col("gateway")).alias("gateway"), F.col("amount"), F.col("currency"),
        F.col("status"), F.col("latency_ms"), F.col("failure_reason"), F.col("user")))
    ing_body = F.to_json(F.struct(
        F.col("txn_id"), F.col("order_id"), F.col("txn_type"), F.col("method"), F.col("provider"),
        F.col("gateway"), F.col("amount"), F.col("currency"), F.col("status"), F.col("latency_ms"),
        F.col("failure_reason"), F.col("user")))

    body = (F.when(e == 0, rz_body).when(e == 1, st_body).when(e == 2, pp_body).when(e == 3, cf_body)
            .when(e == 4, pu_body).when(e.isin(5, 6), uni_body).otherwise(ing_body))
    endpoint = F.element_at(F.array(*[F.lit(x) for x in ENDPOINTS]), (e + 1).cast("int"))
    d = t.select("seq", "ts", endpoint.alias("endpoint"),
                 body.alias("body"), e.alias("_e"), bad.alias("_bad"), st_t.alias("_t"))
    b = F.col("body")
    wrong = "wrong-secret"
    rz_sig = F.when(F.col("_bad"), hmac_sha256_hex(wrong, b)).otherwise(hmac_sha256_hex(HOOK_SECRETS["RAZORPAY"], b))
    good_v1 = hmac_sha256_hex(HOOK_SECRETS["STRIPE"], F.concat(F.col("_t"), F.lit("."), b))
    bad_v1 = hmac_sha256_hex(wrong, F.concat(F.col("_t"), F.lit("."), b))
    st_sig = (F.when(F.col("_bad"), F.concat(F.lit("t="), F.col("_t"), F.lit(",v1="), bad_v1))
              .when(F.col("seq") % 2 == 0, F.concat(F.lit("t="), F.col("_t"), F.lit(",v1="), bad_v1,
                                                    F.lit(", v1="), good_v1))
              .otherwise(F.concat(F.lit("t="), F.col("_t"), F.lit(",v1="), good_v1)))
    pp_resp = F.get_json_object(b, "$.response")
    pp_sig = F.concat(F.sha2(F.concat(pp_resp, F.when(F.col("_bad"), F.lit(wrong))
                                      .otherwise(sec("PHONEPE"))).cast("binary"), 256),
                      F.lit("###"), pp_idx)
    cf_sig = F.when(F.col("_bad"), hmac_sha256_b64(wrong, F.concat(F.col("_t"), b))).otherwise(
        hmac_sha256_b64(HOOK_SECRETS["CASHFREE"], F.concat(F.col("_t"), b)))
    uni_sig = F.when(F.col("_bad"), hmac_sha256_hex(wrong, b)).when(F.col("seq") % 2 == 0, hmac_sha256_hex(
        HOOK_SECRETS["CCAVENUE"], b)).otherwise(hmac_sha256_b64(HOOK_SECRETS["CCAVENUE"], b))
    ee = F.col("_e")
    headers = (F.when(ee == 0, F.create_map(F.lit("x-razorpay-signature"), rz_sig))
               .when(ee == 1, F.create_map(F.lit("stripe-signature"), st_sig))
               .when(ee == 2, F.create_map(F.lit("x-verify"), pp_sig))
               .when(ee == 3, F.create_map(F.lit("x-webhook-signature"), cf_sig,
                                           F.lit("x-webhook-timestamp"), F.col("_t")))
               .when(ee == 4, F.create_map(F.lit("content-type"), F.lit("application/x-www-form-urlencoded")))
               .when(ee.isin(5, 6), F.create_map(F.lit("x-webhook-signature"), uni_sig))
               .otherwise(F.create_map(F.lit("x-api-key"), F.when(F.col("_bad"), F.lit("bad"))
                                       .otherwise(F.lit(HOOK_INGEST_KEY)))))
    out = d.select("seq", "endpoint", headers.alias("headers"), "body", F.col("ts").alias("received_at"))
    # deliveries land in a bronze table: written once, parsed from storage
    from .materialize import materialize
    return materialize(out, "v_hook")
