"""Exact search, mixing, WARC, quotation linking and the pipeline."""
from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import chat, topk, warc
from vigil.llm.mixing import mix

from .conftest import SF, needs_tables, words


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(300)]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]),
           (None, [0.0] * 4), (304, [1.0, 2.0]), (320, []), (305, [1e6, -1e6, 1e6, 1e6]), (5, vecs[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vecs + odd], "vec_id long, embedding array<double>, dim int, shard int")
    got = topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=7, shard_rows=16, block_rows=4, fan_in=3).collect()
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in vecs + odd
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in dict((i, v) for i, v in fine if i % 20 == 0).items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(b) == len(a))[:7]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_top_k(df.limit(0), df).collect() == [] and topk.exact_top_k(df, df.limit(0)).collect() == []


def test_top_k_broadcasts_nothing(spark):
    """Packed tables look small in their files: an estimate must not send every tile's queries through the driver."""
    df = spark.createDataFrame([(i, [i / 64, 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=3, shard_rows=16, block_rows=4)
    assert got.count() == 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" in plan


def test_packed_components_stay_exact():
    for edge in (2 ** 7, 2 ** 15, 2 ** 31, 2 ** 62):
        m = np.array([[-edge, edge - 1, 0], [1, -1, edge]])
        assert topk.widen(topk.narrow(m).tobytes(), 2, 3).tolist() == m.tolist()
    assert topk.widen(b"", 3, 0).shape == (3, 0) and topk.narrow(np.array([[-128, 127]])).dtype == np.int8


def test_products_are_exact():
    q, c = np.array([[2 ** 40, -3]]), np.array([[2 ** 21, 5], [1, 1]])
    assert topk.products(q, c).tolist() == [[2 ** 61 - 15, 2 ** 40 - 3]]


def brute_targets(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        level = rest / open_ if open_ else 0
        more = {s for s in order if s not in capped and weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= more


def test_mix(spark, docs):
    rng = random.Random(1)
    rows = [(i, words(rng.randint(0, 40)), "en", rng.choice(["b", "a", "ä", "Z", None, "hot", "hot", "hot"])) for i in range(400)]
    rows += [(500, None, "en", "a"), (None, words(9), "en", "b"), (7, words(11), "en", "b"), (7, words(11), "en", "b"), (600, words(3), "en", "tiny")]
    df = docs(rows)
    got = mix(df).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert len(got) == len(rows)
    want = brute_targets(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    assert all(taken[s] == round(want[s]) for s in sizes)
    again = mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix(docs([])).collect() == []


def test_mix_prefers_quality(spark, docs):
    df = docs([(i, words(10), "en", s) for i in range(600) for s in ("a", "b")][:1200])
    weight = spark.range(600).selectExpr("id as doc_id", "if(id % 2 = 0, 9.0, 0.5) as weight")
    got = mix(df, weights=(1.0, 5.0), quality=weight).where("source = 'a'").collect()
    good = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert good > 2 * sum(r.taken for r in got if r.doc_id % 2 == 1)


def test_warc_round_trip(spark):
    big = "ü\r\n\r\nWARC/1.0 " * 9000
    rows = [(1, "http://a/\r\nx", "<p>hi</p>"), (2, "u", big), (9, "u", big), (3, None, big), (4, "u", None), (5, "u", ""),
            (None, "u", big), (6, "u", "x" * 1000), (8, "u", "x" * 1000), (8, "u", "x" * 1000), (7, "u", "x" * 999), (10, "u", "x" * 999)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, n int, digest string")
    got = warc.round_trip(df, segment_bytes=4096).collect()
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    want = []
    for i, p in payload:
        first = max((j for j, q in payload if q == p and j is not None), default=None) if len(p) >= 1000 else None
        again = first is not None and i != first
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_damaged_segments(spark, tmp_path):
    """A missing segment and a broken total leave no payload; whole records beside them are read."""
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 100)
    def seg(rid, n, piece, total=None):
        kind = "response" if n == 1 else "continuation"
        f = [("WARC-Type", kind), ("WARC-Record-ID", rid if n == 1 else f"{rid}-{n}"), ("WARC-Segment-Number", str(n)),
             ("WARC-Segment-Origin-ID", None if n == 1 else rid), ("WARC-Segment-Total-Length", total)]
        return warc.record(f, piece)
    size = str(len(block))
    recs = [seg("good", 2, block[100:], size), seg("good", 1, block[:100]), seg("gap", 1, block[:50]), seg("gap", 3, block[100:], size),
            seg("sum", 1, block[:50]), seg("sum", 2, block[50:], "9"), warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "one")], block)]
    (tmp_path / "a.warc").write_bytes(b"".join(r + warc.END for r in recs))
    got = {r.record_id: r.payload_bytes for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"good": 300, "gap": None, "sum": None, "one": 300}
    assert warc.dechunked(b"3\r\nabcX0\r\n\r\n") is None and warc.dechunked(b"zz\r\n") is None


def test_quotations(spark):
    rows = [("t", "1", 1, "a", "Hello all\n\nfirst idea"), ("t", "2", 2, "b", "On Mon, a wrote:\n> hello   ALL\n>\n> first idea\n\nI agree"),
            ("t", "3", 3, "c", "> > first idea\n> I agree\n>> Hello all\nMe too"), ("t", "4", 4, "d", "> first idea\nBut no"),
            ("u", "1", 9, "e", "> But no\nquoted from elsewhere"), ("u", "2", 10, "f", "> never said\nhm"), ("u", "3", 11, None, None),
            (None, "1", 1, "g", "lonely"), (None, "2", 2, "h", "> lonely\nnot now"), ("t", "4", 4, "d", "> first idea\nBut no"),
            ("u", "4", 12, "i", "> quoted from elsewhere\nquoted from elsewhere")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "thread string, msg string, sent long, author string, body string, key int, line int")
    got = {(r.thread, r.msg): r for r in chat.link_quotations(df).collect()}
    assert len(got) == 10
    parent = {k: (r.parent_thread, r.parent) for k, r in got.items()}
    assert parent[("t", "2")] == ("t", "1") and parent[("t", "3")] == ("t", "2") and parent[("t", "4")] == ("t", "1")
    assert parent[("u", "1")] == ("t", "4") and parent[("u", "2")] == (None, None) and parent[("u", "4")] == ("u", "1")
    assert parent[(None, "2")] == (None, "1")
    assert got[("t", "2")].text == "I agree" and got[("t", "3")].text == "Me too" and got[("u", "3")].text == ""
    assert (got[("u", "4")].depth, got[("u", "4")].root) == (3, "t/1")
    order = sorted((r.position, k) for k, r in got.items() if r.root == "t/1")
    assert [k for _, k in order] == [("t", "1"), ("t", "2"), ("t", "4"), ("t", "3"), ("u", "1"), ("u", "4")]
    assert chat.link_quotations(df.limit(0)).collect() == []


def test_quoted_message_missing(spark):
    """A reply to a deleted message hangs on the nearest quoted ancestor that is there; level one goes first."""
    rows = [("t", "1", 1, "a", "root line\nsecond line"), ("t", "3", 3, "c", ">> root line\n>> second line\n> deleted words\nreply"),
            ("t", "4", 4, "d", ">>> root line\n>>> second line\n> reply\nlast")]
    got = {r.msg: r for r in chat.link_quotations(spark.createDataFrame(
        rows, "thread string, msg string, sent long, author string, body string")).collect()}
    assert (got["3"].parent, got["3"].linked, got["3"].depth) == ("1", 2, 1)
    assert (got["4"].parent, got["4"].linked, got["4"].depth) == ("3", 1, 2)


def test_common_line_of_one_thread(spark):
    """A line that every message of a thread has and quotes links each to the one before."""
    rows = [("t", str(i), i, "a", "> same line\nsame line" if i else "same line") for i in range(300)]
    got = chat.link_quotations(spark.createDataFrame(rows, "thread string, msg string, sent long, author string, body string")).collect()
    assert {r.msg: r.depth for r in got} == {str(i): i for i in range(300)}


@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name == "near_dedup":  # one of each exact copy
            assert docs.groupBy("text").count().where("count > 1").isEmpty()
        if name == "secret_scan":
            assert docs.count() == before.count()
        ids = now
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} <= ids and all(0 < r.taken <= 3 * r.size for r in last)


def test_stages_with_clashing_column_names(spark):
    """Every stage passes columns whose names the operators use inside."""
    odd = ["score", "rejected", "lang_pred", "_bad", "_bad_text", "_text_key", "_secret", "key", "rank", "node"]
    rows = [(i, f"The quick note number {i} says {words(12, 40 * i)} and ends.", "en", "s", 60) for i in range(30)]
    rows += [(40, 'password: "hunter2hunter2x" is what she wrote down here today', "en", "s", 60), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"'{c}' as {c}" for c in odd])
    items = spark.createDataFrame([(1, words(8, 40 * 3))], "item_id long, text string")
    from vigil.llm import decontam, secrets
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {"score"}
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {3}
    hidden = secrets.redact(docs, secrets.train(secrets.labelled_findings(docs)))
    got = {r.doc_id: r for r in hidden.collect()}
    assert hidden.columns == docs.columns and len(got) == len(rows)
    assert "hunter2" not in got[40].text and all(r[c] == c for r in got.values() for c in odd)
