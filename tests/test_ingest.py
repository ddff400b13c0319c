from __future__ import annotations

import hashlib
import hmac
import json
import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from vigil.sources import otlp as OT
from vigil.sources import webhooks as WH


def test_hmac_matches_python(spark):
    for secret in ["s", "k" * 64, "x" * 100]:
        msgs = ["", "hello", '{"a": 1}']
        df = spark.createDataFrame([(m,) for m in msgs], "m string")
        got = [r["h"] for r in df.select(WH.hmac_sha256_hex(secret, F.col("m")).alias("h")).collect()]
        want = [hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest() for m in msgs]
        assert got == want


def test_stripe_two_v1_second_matches(spark):
    body = '{"type": "payment_intent.succeeded"}'
    good = hmac.new(b"whsec", f"123.{body}".encode(), hashlib.sha256).hexdigest()
    rows = [(f"t=123,v1=deadbeef, v1={good}",), ("t=123,v1=deadbeef",), (f"v1={good}",)]
    df = spark.createDataFrame(rows, "h string")
    got = [r["ok"] for r in df.select(WH.stripe_signature_ok("whsec", F.col("h"), F.lit(body)).alias("ok")).collect()]
    assert got == [True, False, False]


def test_razorpay_normalisation_and_outcomes(spark):
    secret = "rzp"
    ok_body = json.dumps({"event": "payment.captured", "created_at": 100, "payload": {"payment": {"entity": {
        "id": "pay_1", "order_id": "o1", "method": "upi", "vpa": "abc@ybl", "amount": 12345, "currency": "inr",
        "created_at": 98, "email": "jonathan@x.io"}}}})
    ignored = json.dumps({"event": "payment.dispute", "payload": {}})
    sig = hmac.new(secret.encode(), ok_body.encode(), hashlib.sha256).hexdigest()
    sig2 = hmac.new(secret.encode(), ignored.encode(), hashlib.sha256).hexdigest()
    rows = [(1, "razorpay", {"x-razorpay-signature": sig}, ok_body),
            (2, "razorpay", {"x-razorpay-signature": "bad"}, ok_body),
            (3, "razorpay", {"x-razorpay-signature": sig2}, ignored),
            (4, "stripe", {}, "{}")]
    df = spark.createDataFrame(rows, "seq long, endpoint string, headers map<string,string>, body string") \
        .withColumn("received_at", F.current_timestamp())
    out = {r["seq"]: r for r in WH.normalize_webhooks(df, {"RAZORPAY": secret}).collect()}
    assert [out[i]["outcome"] for i in (1, 2, 3, 4)] == ["ok", "bad_signature", "ignored", "no_secret"]
    r = out[1]
    assert (r["txn_id"], r["method"], r["provider"], r["amount"], r["currency"], r["latency_ms"], r["user"]) == \
        ("pay_1", "UPI", "ybl", 123.45, "INR", 2000.0, "jonat***")


def test_otlp_flatten_edge_cases(spark):
    trace = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]},
             "scopeSpans": [{"scope": {"name": "s"}, "spans": [
                 {"traceId": "t", "spanId": "a", "parentSpanId": "", "name": "root",
                  "startTimeUnixNano": "1000000000", "endTimeUnixNano": "1500000000", "status": {},
                  "attributes": [{"key": "http.route", "value": {"intValue": "7"}}]},
                 {"traceId": "t", "spanId": "b", "name": "child", "startTimeUnixNano": "0",
                  "endTimeUnixNano": "5", "status": {"code": 2},
                  "attributes": [{"key": "http.route", "value": {"stringValue": "/x"}}]}]}]},
             {"resource": {"attributes": []}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "c",
                                                                         "name": "n"}]}]}]}
    metrics = {"resourceMetrics": [{"scopeMetrics": []}]}
    rows = [(json.dumps(trace),), (json.dumps(metrics),), ("not json",), ("",), ("[1, 2]",)]
    raw = spark.createDataFrame(rows, "payload string")
    spans, logs = OT.route_signals(raw)
    got = {r["span_id"]: r for r in spans.collect()}
    assert set(got) == {"a", "b", "c"} and logs.count() == 0
    assert got["a"]["route"] == "root" and got["a"]["duration_ms"] == 500.0 and got["a"]["status_code"] == 0
    assert got["b"]["route"] == "/x" and got["b"]["duration_ms"] == 0.0 and got["b"]["status_code"] == 2
    assert got["c"]["service_name"] is None
    assert OT.parse_messages(raw).count() == 2


def test_load_baseline(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "warm.jsonl")
    with open(p, "w") as f:
        f.write('{"duration_ms": 12.5}\n\n{broken\n{"duration_ms": 3}\n')
    got = sorted(r["duration_ms"] for r in OT.load_baseline(spark, p).collect())
    assert got == [3.0, 12.5]
    assert OT.load_baseline(spark, os.path.join(d, "missing.jsonl")).count() == 0


def _post(spark, rows):
    df = spark.createDataFrame(rows, "seq long, endpoint string, headers map<string,string>, body string")
    return df.withColumn("received_at", F.current_timestamp())


def _hex(secret, msg):
    return hmac.new(secret.encode(), msg.encode(), hashlib.sha256).hexdigest()


def test_gateways_golden_with_missing_fields(spark):
    import base64
    secrets = {"STRIPE": "whsec", "PHONEPE": "salt", "CASHFREE": "cf", "PAYU": "payu", "GATEWAY": "shared"}
    # Stripe: no payment_method_types, no metadata / invoice, refund amount only
    st_body = json.dumps({"type": "charge.refunded", "data": {"object": {"id": "ch_1", "amount_refunded": 250,
                                                                         "currency": "eur"}}})
    st_sig = "t=9,v1=" + _hex("whsec", "9." + st_body)
    # PhonePe: pending, salt index 3
    inner = json.dumps({"data": {"state": "PENDING", "merchantTransactionId": "m1", "amount": 1000,
                                 "mobileNumber": "9876543210"}})
    b64 = base64.b64encode(inner.encode()).decode()
    pp_body = json.dumps({"response": b64})
    pp_sig = hashlib.sha256((b64 + "salt").encode()).hexdigest() + "###3"
    # Cashfree: no "data" wrapper (fall-through), failed with a reason
    cf_body = json.dumps({"payment": {"cf_payment_id": 77, "payment_status": "FAILED", "payment_group": "card",
                                      "payment_amount": 5.5, "error_details": {"error_reason": "declined"}},
                          "order": {"order_id": "o9"}})
    cf_sig = base64.b64encode(hmac.new(b"cf", ("123" + cf_body).encode(), hashlib.sha256).digest()).decode()
    # PayU: success by UPI, hash over the reverse sequence
    form = {"key": "k", "txnid": "t1", "amount": "10.50", "productinfo": "p", "firstname": "f",
            "email": "someone@x.io", "status": "success", "mode": "UPI", "mihpayid": "m99"}
    seq = ["payu", "success", "", "", "", "", "", "", "", "", "", "", "someone@x.io", "f", "p", "10.50", "t1", "k"]
    form["hash"] = hashlib.sha512("|".join(seq).encode()).hexdigest()
    pu_body = "&".join(f"{k}={v}" for k, v in form.items())
    # universal: unknown gateway name uses the shared secret; defaults fill the gaps
    uni_body = json.dumps({"amount": 12.345, "status": "FAILED"})
    uni_sig = base64.b64encode(hmac.new(b"shared", uni_body.encode(), hashlib.sha256).digest()).decode()
    rows = [(1, "stripe", {"stripe-signature": st_sig}, st_body),
            (2, "phonepe", {"x-verify": pp_sig}, pp_body),
            (3, "cashfree", {"x-webhook-signature": cf_sig, "x-webhook-timestamp": "123"}, cf_body),
            (4, "payu", {}, pu_body),
            (5, "gateway/newpay", {"x-webhook-signature": uni_sig}, uni_body),
            (6, "ingest", {"x-api-key": "key"}, json.dumps({"txn_id": "x"}))]
    out = {r["seq"]: r for r in WH.normalize_webhooks(_post(spark, rows), secrets, "key").collect()}
    assert [out[i]["outcome"] for i in range(1, 7)] == ["ok", "ok", "ok", "ok", "ok", "invalid"]
    s = out[1]
    assert (s["txn_type"], s["method"], s["order_id"], s["amount"], s["currency"], s["provider"], s["user"]) == \
        ("REFUND", "CREDIT_CARD", "—", 2.5, "EUR", "Stripe", "customer***")
    p = out[2]
    assert (p["status"], p["txn_id"], p["amount"], p["failure_reason"], p["user"]) == \
        ("PENDING", "m1", 10.0, "PENDING", "98765***")
    c = out[3]
    assert (c["status"], c["txn_id"], c["order_id"], c["method"], c["amount"], c["failure_reason"]) == \
        ("FAILED", "77", "o9", "CREDIT_CARD", 5.5, "declined")
    u = out[4]
    assert (u["status"], u["txn_id"], u["order_id"], u["method"], u["amount"], u["user"]) == \
        ("SUCCESS", "m99", "t1", "UPI", 10.5, "someo***")
    g = out[5]
    assert (g["gateway"], g["provider"], g["txn_type"], g["method"], g["amount"], g["status"], g["order_id"]) == \
        ("Newpay", "Newpay", "PURCHASE", "UPI", 12.35, "FAILED", "—")
    assert g["txn_id"].startswith("TXN") and len(g["txn_id"]) == 15


def test_unknown_root_object_gives_no_rows(spark):
    raw = spark.createDataFrame([('{"foo": 1}',), ('{"resourceMetrics": []}',)], "payload string")
    msgs = OT.parse_messages(raw)
    assert msgs.count() == 2
    assert OT.flatten_spans(msgs).count() == 0 and OT.flatten_logs(msgs).count() == 0


def test_messages_are_decoded_once(spark):
    """Filters and fields of a message share one parse; undecodable lines keep their reason."""
    span = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s"}]}]}]})
    log = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "5000"}]}]}]})
    raw = spark.createDataFrame([(1, span), (2, log), (3, "{oops"), (4, "[1]"), (5, " "), (6, None), (7, "{}")], "k int, payload string")
    msgs = OT.parse_messages(raw)
    for df, n in ((OT.flatten_spans(msgs), 1), (OT.flatten_logs(msgs), 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and df.count() == n
    got = {r["k"]: (r["reason"], r["msg"] is not None) for r in OT.decode_messages(raw).collect()}
    assert got == {1: (None, True), 2: (None, True), 3: ("not JSON", False), 4: ("not an object", False),
                   5: ("empty", False), 6: ("empty", False), 7: (None, True)}


def test_trace_messages_are_grouped_where_spans_are_numbered(spark):
    from vigil.plans.vehicles_ingest import otlp_trace_messages
    rows = [(5, "5", i, f"s{i}", "", s, "n", 1.5, datetime(2024, 1, 1), 0) for i, s in enumerate("aab")] + [
        (None, None, 1, "s1", "", "a", "n", 1.5, datetime(2024, 1, 1), 0)]
    spans = spark.createDataFrame(rows, "trace_seq long, trace_id string, rn int, span_id string, parent_span_id string, "
                                        "service string, name string, duration_ms double, start_time timestamp, status_code int")
    msgs = otlp_trace_messages(spark, "", spans.repartition(3, "trace_seq"))
    assert msgs.count() == 3
    plan = msgs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_a_webhook_body_is_decoded_once(spark):
    """Fields, outcome and transaction read one decoded column per payload schema."""
    secrets = dict.fromkeys(("RAZORPAY", "STRIPE", "PHONEPE", "CASHFREE", "PAYU", "CCAVENUE"), "s")
    df = _post(spark, [(1, "razorpay", {}, "{}"), (2, "phonepe", {"x-verify": "no"}, '{"response":"A"}'), (3, "payu", {}, None)])
    out = WH.normalize_webhooks(df, secrets, "key")
    # six payload schemas, each of which the plan names twice
    assert out._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.JsonToStructs") <= 12
    assert [r["outcome"] for r in out.orderBy("seq").collect()] == ["bad_signature"] * 3
