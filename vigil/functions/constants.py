"""Fixed values that results depend on.

FIXED VALUES — these must equal the monitored system's own names, maps and
thresholds for results to match; they are stated plainly, in natural order.
"""

# FIXED VALUES: service names, in the order used for ``id % 6`` assignment.
SERVICES = ["api-gateway", "payment-service", "order-service",
            "fraud-service", "wallet-service", "notification-service"]

# FIXED VALUES: payment domains.
TXN_TYPES = ["PURCHASE", "REFUND", "SUBSCRIPTION", "TRANSFER", "PAYOUT", "TOPUP"]
TXN_METHODS = ["UPI", "CREDIT_CARD", "DEBIT_CARD", "NET_BANKING", "WALLET",
               "BANK_TRANSFER", "BNPL"]
# first provider of each method (same order as TXN_METHODS)
METHOD_PROVIDER = ["GPay", "Visa", "Visa Debit", "HDFC", "Paytm Wallet", "NEFT", "Simpl"]
TXN_GATEWAYS = ["Razorpay", "Stripe", "PayU", "CCAvenue", "Cashfree", "JusPay"]
FAILURE_REASONS = ["UPI_APP_TIMEOUT", "INVALID_VPA", "INSUFFICIENT_FUNDS",
                   "BANK_UNAVAILABLE", "BANK_DECLINED"]

# FIXED VALUES: payment detector tuning.
PAY_TUNING = {
    "fail_window": 12,
    "fail_min": 3,
    "fail_rate": 0.50,
    "velocity_per_min": 5,
    "velocity_window_s": 60,
    "velocity_memory": 60,
    "dup_window_s": 120,
    "latency_ms": 8000,
    "refire_cooldown_s": 45,
    "throughput_window_s": 60,
    "throughput_memory": 1000,
    "p99_memory": 300,
}

# FIXED VALUES: trace rule detectors.
N_PLUS_1_K = 3.0
N_PLUS_1_WARMUP = 10
N_PLUS_1_FLOOR = 10
BIMODAL_LAMBDA = 0.2
BIMODAL_STD_MS = 500.0
BIMODAL_MEAN_MIN_MS = 200.0
BIMODAL_WARMUP = 10
SPAN_SLOW_MS = 500.0

# FIXED VALUES: PII density detector.
PII_WINDOW_S = 60
PII_THRESHOLD = 0.8
PII_MIN_LOGS = 5
PII_COOLDOWN_S = 60
LOG_BUFFER_MAX_PER_TRACE = 50

# FIXED VALUES: redaction patterns (RE2 form) and their replacement tokens.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CARD_PATTERN_RE2 = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"
AUTHOR_PATTERN_RE2 = r'"author":\s*"[^"]*"'
EMAIL_TOKEN = "[REDACTED_EMAIL]"
CARD_TOKEN = "[REDACTED_CC]"
AUTHOR_REPLACEMENT = '"author": "[REDACTED_AUTHOR]"'
REDACTION_TOKENS = ["[REDACTED_EMAIL]", "[REDACTED_AUTHOR]", "[REDACTED_CC]"]

# FIXED VALUES: Kubernetes nodes (name, zone, cpu capacity m, memory capacity Mi).
K8S_NODES = [
    ("node-pool-a1", "ap-south-1a", 4000, 16384),
    ("node-pool-a2", "ap-south-1b", 4000, 16384),
    ("node-pool-b1", "ap-south-1a", 8000, 32768),
]
K8S_CPU_OVERHEAD_M = 350
K8S_MEM_OVERHEAD_MI = 1200

# FIXED VALUES: gateway registry (name, region, method, path, scheme, secret_key).
GATEWAY_REGISTRY = [
    ("Razorpay", "India", "webhook", "/api/webhooks/razorpay", "HMAC-SHA256 (X-Razorpay-Signature)", "RAZORPAY"),
    ("Stripe", "Global", "webhook", "/api/webhooks/stripe", "Stripe-Signature (t=,v1=)", "STRIPE"),
    ("PhonePe", "India", "webhook", "/api/webhooks/phonepe", "X-VERIFY SHA256###saltIndex", "PHONEPE"),
    ("Cashfree", "India", "webhook", "/api/webhooks/cashfree", "HMAC-SHA256 (x-webhook-signature)", "CASHFREE"),
    ("PayU", "India", "webhook", "/api/webhooks/payu", "SHA512 reverse hash", "PAYU"),
    ("Paytm", "India", "webhook", "/api/webhooks/gateway/paytm", "HMAC-SHA256 (X-Webhook-Signature)", "PAYTM"),
    ("JusPay", "India", "webhook", "/api/webhooks/gateway/juspay", "HMAC-SHA256 (X-Webhook-Signature)", "JUSPAY"),
    ("CCAvenue", "India", "webhook", "/api/webhooks/gateway/ccavenue", "HMAC-SHA256 (X-Webhook-Signature)", "CCAVENUE"),
    ("Custom", "Any", "webhook", "/api/webhooks/gateway/custom", "HMAC-SHA256 (X-Webhook-Signature)", "CUSTOM"),
]

# FIXED VALUES: webhook status / method maps.
RAZORPAY_STATUS = {"payment.captured": "SUCCESS", "payment.authorized": "PENDING",
                   "payment.failed": "FAILED", "refund.processed": "SUCCESS",
                   "refund.failed": "FAILED"}
RAZORPAY_METHOD = {"upi": "UPI", "card": "CREDIT_CARD", "netbanking": "NET_BANKING",
                   "wallet": "WALLET", "emi": "BNPL", "bank_transfer": "BANK_TRANSFER"}
STRIPE_STATUS = {"payment_intent.succeeded": "SUCCESS", "payment_intent.processing": "PENDING",
                 "payment_intent.payment_failed": "FAILED", "charge.refunded": "SUCCESS"}
STRIPE_METHOD = {"card": "CREDIT_CARD", "upi": "UPI", "netbanking": "NET_BANKING", "wallet": "WALLET"}
PHONEPE_SUCCESS = ["COMPLETED", "SUCCESS", "PAYMENT_SUCCESS"]
CASHFREE_SUCCESS = ["SUCCESS", "PAID"]
CASHFREE_METHOD = {"upi": "UPI", "card": "CREDIT_CARD", "netbanking": "NET_BANKING", "app": "WALLET"}
PAYU_METHOD = {"upi": "UPI", "cc": "CREDIT_CARD", "dc": "DEBIT_CARD", "nb": "NET_BANKING", "cash": "WALLET"}

# FIXED VALUES: dashboard bands.
SEVERITY_CRITICAL = 0.8
SEVERITY_WARNING = 0.5

# FIXED VALUES: suggested fixes per incident kind (three each), and the default.
FIXES = {
    "n_plus_1": ["Implement eager loading (JOINs) for related entities",
                 "Batch queries using DataLoader pattern",
                 "Enable query logging to identify the exact ORM call"],
    "bimodal": ["Check cache hit rates and TTL configuration",
                "Investigate thread pool or connection pool exhaustion",
                "Add circuit breakers for downstream calls"],
    "dependency": ["Ensure W3C trace context is propagated in HTTP headers",
                   "Check network reliability between services",
                   "Verify OTel auto-instrumentation compatibility"],
    "pii": ["Audit logging configuration to prevent PII leakage",
            "Review recent code changes for new debug logs",
            "Implement stricter egress filtering"],
    "failure_spike": ["Fail over traffic from {gateway} to a healthy PSP via routing rules",
                      "Enable automatic gateway retries with exponential backoff",
                      "Check PSP status page and open a priority ticket"],
    "timeout": ["Reduce gateway call timeout and add circuit breaker",
                "Route new transactions to a secondary gateway",
                "Reconcile PENDING transactions once the gateway recovers"],
    "velocity": ["Temporarily block the account and force re-authentication",
                 "Enable step-up verification (OTP/3DS) for high-velocity accounts",
                 "Review device fingerprints linked to the account"],
    "duplicate": ["Auto-refund the duplicate transaction",
                  "Enforce idempotency keys at the gateway adapter layer",
                  "Add uniqueness constraint on (order_id, amount, window)"],
    "crashloop": ["kubectl logs --previous to inspect the crashing container",
                  "Roll back the latest deployment revision",
                  "Verify ConfigMap/Secret mounts and liveness probe thresholds"],
    "oom": ["Raise memory limits/requests after profiling actual usage",
            "Inspect for memory leaks under sustained load",
            "Add HPA on memory utilization to absorb spikes"],
    "other": ["Investigate {service} for recent deployments affecting {route}",
              "Check database indexing and query patterns",
              "Review connection pool metrics"],
}
NO_INCIDENT_HEADLINE = "No active anomalies detected. System operating normally."


# FIXED VALUES: root-cause sentence per incident kind.
ROOT_CAUSES = {
    "n_plus_1":
        "Detected %s sequential DB spans under a single parent, indicating a missing JOIN or unbatched ORM query in %s.",
    "bimodal":
        "Latency distribution for %s has split into two modes (variance ~%s), likely due to intermittent cache misses or resource contention.",
    "dependency":
        "Span references missing parent (%s), indicating a broken trace context or dropped network packet between services.",
    "pii":
        "High density of redacted tokens (%s%%) detected in logs. Possible data exfiltration path or overly verbose logging.",
    "failure_spike":
        "Payment failure rate spiked to %s%% on gateway %s, indicating a PSP-side degradation or expired gateway credentials.",
    "timeout":
        "Gateway %s exceeded timeout budget (%sms), stalling checkout completions.",
    "velocity":
        "Account %s initiated %s transactions/min, far above baseline — pattern consistent with card testing or account takeover.",
    "duplicate":
        "Duplicate charge detected (original %s) — idempotency key was not honored across retries.",
    "crashloop":
        "Pod %s on %s is crash-looping (%s restarts) — likely a failing readiness dependency or bad config rollout.",
    "oom":
        "Container in pod %s was OOMKilled — memory usage exceeded its limit, suggesting a leak or undersized limits.",
    "other":
        "Multiple ML detectors (Isolation Forest, Autoencoder) flagged %s::%s as a severe statistical outlier compared to baseline.",
}

# FIXED VALUES: description of each fired detector.
DETECTOR_TEXTS = {
    "n_plus_1":
        "N+1 Query Regression — span_count=%s (Chebyshev bound on rolling span-count distribution)",
    "bimodal_latency":
        "Bimodal Latency — EWMA variance≈%s (σ exceeds threshold → latency distribution has split into two modes)",
    "dangling_parent":
        "Dependency Chain Break — dangling span '%s' (parent_span_id references a span not present in the reconstructed trace)",
    "pii_redaction_density":
        "PII Redaction Density — %s%% of logs in 60s window redacted (possible data-exfil path or misconfigured logger)",
    "pod_failure":
        "Kubernetes Pod Failure — pod '%s' on node '%s' (deployment=%s, restarts=%s)",
    "payment_failure_spike":
        "Payment Failure Spike — failure rate %s%% on gateway '%s'",
    "gateway_timeout":
        "Gateway Timeout — gateway '%s' exceeded its timeout budget",
    "fraud_velocity":
        "Fraud Velocity — account '%s' at %s transactions/min (card-testing / ATO pattern)",
    "duplicate_charge":
        "Duplicate Charge — idempotency violation, original transaction %s",
}
