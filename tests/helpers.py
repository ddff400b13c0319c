"""Plain-Python re-statements of the detector semantics (loop oracles)."""
from __future__ import annotations

import math
from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)


def txn_rows(specs):
    """specs: (seq, seconds, user, gateway, status, amount, latency_ms)."""
    rows = []
    for seq, sec, user, gw, status, amount, lat in specs:
        rows.append(dict(seq=seq, txn_id=f"TXN{seq}", order_id=f"ORD{seq}", txn_type="PURCHASE",
                         method="UPI", provider="GPay", gateway=gw, amount=float(amount), currency="INR",
                         status=status, latency_ms=float(lat), failure_reason=None, user=user,
                         ts=T0 + timedelta(seconds=sec), source="live"))
    return rows


TXN_SCHEMA = ("seq long, txn_id string, order_id string, txn_type string, method string, provider string, "
              "gateway string, amount double, currency string, status string, latency_ms double, "
              "failure_reason string, user string, ts timestamp, source string")


def loop_payment_alerts(rows, cooldown=45.0):
    """Sequential detectors without the global memory caps."""
    rows = sorted(rows, key=lambda r: (r["ts"], r["seq"]))
    recent_by_gw, user_hits, charges, fired_at, out = {}, {}, [], {}, []

    def should(key, now):
        last = fired_at.get(key)
        if last is None or now - last >= cooldown:
            fired_at[key] = now
            return True
        return False

    for r in rows:
        now = (r["ts"] - T0).total_seconds()
        gw, user = r["gateway"], r["user"]
        recent_by_gw.setdefault(gw, []).append(r)
        last12 = recent_by_gw[gw][-12:]
        if len(last12) >= 3:
            rate = sum(1 for t in last12 if t["status"] == "FAILED") / len(last12)
            if rate >= 0.5 and should(f"fs:{gw}", now):
                out.append(("payment_failure_spike", r["seq"]))
        hits = user_hits.setdefault(user, [])
        hits.append(now)
        hits[:] = hits[-60:]
        per_min = sum(1 for t in hits if now - t <= 60)
        if per_min >= 5 and should(f"vel:{user}", now):
            out.append(("fraud_velocity", r["seq"]))
        if r["status"] != "FAILED" and r["amount"] > 0:
            for (u, a, t, tid) in charges:
                if u == user and abs(a - r["amount"]) < 0.01 and now - t <= 120:
                    if should(f"dup:{user}:{r['amount']}", now):
                        out.append(("duplicate_charge", r["seq"]))
                    break
            charges.append((user, r["amount"], now, r["txn_id"]))
        if r["latency_ms"] >= 8000 and should(f"to:{gw}", now):
            out.append(("gateway_timeout", r["seq"]))
    return sorted(out)


def loop_n_plus_1(counts):
    n, mean, m2, hits = 0, 0.0, 0.0, []
    for i, x in enumerate(counts):
        if n >= 10 and x >= 10:
            var = m2 / (n - 1) if n > 1 else 0.0
            if x > mean + 3 * math.sqrt(var):
                hits.append(i)
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
    return hits


def loop_bimodal(durs):
    n, mean, var, seeded, hits = 0, 0.0, 0.0, False, []
    for i, x in enumerate(durs):
        if n >= 10 and seeded:
            std = math.sqrt(var) if var > 0 else 0.0
            if std > 500 and mean > 200 and x > mean + std:
                hits.append(i)
        if not seeded:
            mean, var, seeded = x, 0.0, True
        else:
            d = x - mean
            var = 0.2 * (d * d) + 0.8 * var
            mean += 0.2 * d
        n += 1
    return hits
