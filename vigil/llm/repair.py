"""Conversation structure repair: turns aligned to an alternating grammar at least cost.

A repaired conversation has the role initials `(s?(ua)+)?`.  Edits: Keep costs 0, Rerole
to user or assistant 3, Delete 4 (blank and repeated turns must go), Insert an empty turn
of user or assistant 3; a truncated turn that stays adds 3.  The cheapest edits are told
by their initials in order, the audit; of equally cheap audits the least in ASCII order
counts.  The letters of an audit that are not D give the length of the repaired
conversation, and there is one grammar string of each length, so an audit says all.

Method.  Every conversation is cut into segments of at most `SEGMENT` turns.  `table`
aligns a segment with the grammar strings of every feasible length by Wagner and Fischer's
recurrence, from the last turn backwards: strings that end alike share their last letters,
so column k of one table is the string of length k.  Ukkonen's band keeps the cells which
the cost of an incumbent (from a narrow band) allows.  The least columns are traced back
to audits and those compared.  A segment is so known by its cheapest audit for each state
of the grammar before and behind it, and neighbours are joined `FAN_IN` at a time, so a
conversation of any length is aligned exactly and no task holds the turns of more than a
segment.  Only `repaired` and `digests` go through one conversation in order in one task
(a SHA-256 has no other way), as a stream that holds one turn and the audit.

Defined results.  A null role or text counts as one space.  Turns are taken by (turn,
nulls first; role; md5 of the text); equal rows count each.  Rows with a null `conv_id`
are one conversation.  Other columns are ignored.  Without turns: zeros, empty audit.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.materialize import materialize
from .common import text_batches

SPACE = " \t\n\x0b\f\r"
SEGMENT = 64
FAN_IN = 64
#: States of the grammar: nothing yet, behind s, behind u, behind a.
START, BEHIND_S, BEHIND_U, BEHIND_A = range(4)
SUMMARY = "array<struct<p:tinyint,q:tinyint,cost:bigint,audit:string>>"


# ------------------------------------------------------------------ one segment

def table(codes: str, last: str, slack_in: int, slack_out: int) -> list[dict[int, int]]:
    """Costs of the turns from i on against the last k letters, as [i][k]; `last` is the last letter.

    Columns are kept where the rest has at most `slack_in` inserted and `slack_out` freely
    deleted turns more than the other (the band).  Codes: x must go; s, u, a, o by role
    initial; capitals are truncated.
    """
    rows: list[dict[int, int]] = [{}] * (len(codes) + 1)
    rows[-1] = {k: 3 * k for k in range(slack_in + 1)}
    free = 0
    other = "u" if last == "a" else "a"
    for i in range(len(codes) - 1, -1, -1):
        code, below, here = codes[i], rows[i + 1], {}
        forced = code == "x"
        free += not forced
        small = code.lower()
        extra = 3 if small != code else 0
        for k in range(max(0, free - slack_out), free + slack_in + 1):
            best = below[k] + 4 if k in below else None
            if k:
                if not forced and k - 1 in below:
                    letter = last if k % 2 else other
                    c = below[k - 1] + extra + (0 if small == letter else 3)
                    best = c if best is None or c < best else best
                if k - 1 in here and (best is None or here[k - 1] + 3 < best):
                    best = here[k - 1] + 3
            if best is not None:
                here[k] = best
        rows[i] = here
    return rows


def traced(codes: str, last: str, rows: list[dict[int, int]], i: int, k: int) -> str:
    """The least audit (D < I < K < R) of the cheapest ones from cell (i, k) to the end."""
    out = []
    other = "u" if last == "a" else "a"
    while i < len(codes) or k:
        cost = rows[i][k]
        if i < len(codes) and rows[i + 1].get(k, -9) + 4 == cost:
            out.append("D")
            i += 1
        elif k and rows[i].get(k - 1, -9) + 3 == cost:
            out.append("I")
            k -= 1
        else:
            out.append("K" if codes[i].lower() == (last if k % 2 else other) else "R")
            i, k = i + 1, k - 1
    return "".join(out)


def kept_s(codes: str, last: str, rows: list[dict[int, int]], k: int) -> tuple[int, str] | None:
    """Cheapest (cost, audit) of a kept s turn followed by the last k letters."""
    best = None
    for i, code in enumerate(codes):
        if code.lower() == "s" and k in rows[i + 1]:
            cost = 4 * i + (3 if code == "S" else 0) + rows[i + 1][k]
            if best is None or cost <= best[0]:
                found = cost, "D" * i + "K" + traced(codes, last, rows, i + 1, k)
                best = found if best is None else min(best, found)
    return best


@lru_cache(maxsize=20000)
def aligned(codes: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state behind, cost, audit): the cheapest ways through a segment."""
    n = len(codes)
    gone = 4 * n, "D" * n
    best: dict[tuple[int, int], tuple[int, str]] = {(p, p): gone for p in range(4)}

    def offer(p, q, found):
        if found is not None and ((p, q) not in best or found < best[p, q]):
            best[p, q] = found

    empty = [{0: 4 * (n - i)} for i in range(n + 1)]
    offer(START, BEHIND_S, kept_s(codes, "a", empty, 0))
    base = sum(4 if c == "x" else 3 if c.isupper() else 0 for c in codes)
    cut = sum(c.isupper() for c in codes)
    for last, behind in (("a", BEHIND_A), ("u", BEHIND_U)):
        narrow = table(codes, last, 2, 2)[0]
        whole = {}
        for rest in (0, 1):  # the first letter is the last one if the length is odd
            found = [(c, k) for k, c in narrow.items() if k and k % 2 == rest]
            whole[rest] = min(found)[0] if found else base + 3 * n + 6
        slack = max(whole.values()) - base
        rows = table(codes, last, slack // 3 + 1, min(cut, slack) + max(0, slack - cut) // 4 + 1)
        odd_first = (last == "u")
        for rest in (0, 1):
            first_u = odd_first if rest else not odd_first
            lengths = [k for k in rows[0] if k and k % 2 == rest]
            least = min(rows[0][k] for k in lengths)
            audit = min(traced(codes, last, rows, 0, k) for k in lengths if rows[0][k] == least)
            for p in (START, BEHIND_S, BEHIND_A) if first_u else (BEHIND_U,):
                offer(p, behind, (least, audit))
            if first_u and any(c in "sS" for c in codes):
                for k in sorted({k for r in rows for k in r if k and k % 2 == rest}):
                    offer(START, behind, kept_s(codes, last, rows, k))
    return tuple((p, q, *v) for (p, q), v in sorted(best.items()))


def joined(summaries) -> list[dict]:
    """One summary of neighbouring ones in order."""
    total: dict | None = None
    for s in summaries:
        part = {(w["p"], w["q"]): (w["cost"], w["audit"]) for w in s}
        if total is None:
            total = part
            continue
        out: dict = {}
        for (p, m), (cost, audit) in total.items():
            for (m2, q), (more, rest) in part.items():
                if m == m2:
                    found = cost + more, audit + rest
                    if (p, q) not in out or found < out[p, q]:
                        out[p, q] = found
        total = out
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in (total or {}).items()]


# ------------------------------------------------------------------ the turns in Spark

def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text_key, content (of conversation, role and text), initial, blank, cut."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    trimmed = F.rtrim(text, F.lit(SPACE))
    return turns.select(
        "conv_id", "turn", role.alias("role"), F.md5(text).alias("text_key"),
        F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")),
                           F.length(role).cast("string"), role, text), 256).alias("content"),
        F.left(role, F.lit(1)).alias("initial"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def ordered(turns: DataFrame) -> DataFrame:
    """`marked` turns with (part, at), which grow in the order of each conversation.

    The rows are dealt by ranges of (conversation, order): a conversation with a third of
    all turns is spread over many parts.  The last key tells equal rows apart.
    """
    parts = 4 * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (marked(turns).withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange(parts, "conv_id", "turn", "role", "text_key", "row")
             .withColumn("part", F.spark_partition_id()))
    dealt = materialize(dealt, "repair-turns")
    return dealt.withColumn("at", F.expr(
        "row_number() over (partition by conv_id, part order by turn nulls first, role, text_key, row) - 1"))


def segments(turns: DataFrame) -> DataFrame:
    """A row per (conversation, part, segment): codes and initials of its turns, counts of faults."""
    rows = materialize(ordered(turns).select("conv_id", "part", "at", "content", "initial", "blank", "cut"), "repair-order")
    firsts = (rows.groupBy("content").agg(F.min(F.struct("part", "at")).alias("first"), F.count("*").alias("times"))
              .where("times > 1").select("content", "first"))
    fault = F.expr("""case when blank then 'blank' when struct(part, at) > first then 'duplicate'
                           when cut then 'truncated' end""")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    coded = (rows.join(firsts, "content", "left").withColumn("fault", fault).withColumn("kind", kind)
             .withColumn("code", F.expr("""case when fault in ('blank', 'duplicate') then 'x'
                                                when fault = 'truncated' then upper(kind) else kind end""")))
    line = "array_join(transform(array_sort(collect_list(struct(at, {0}))), x -> x.{0}), '')"
    return (coded.withColumn("segment", F.expr(f"at div {SEGMENT}"))
            .groupBy("conv_id", "part", "segment")
            .agg(F.expr(line.format("code")).alias("codes"), F.expr(line.format("kind")).alias("kinds"),
                 *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]))


def broken_pairs(kinds: str) -> int:
    return sum(kinds[i:i + 2] not in ("su", "ua", "au") for i in range(len(kinds) - 1))


SEGMENT_ROW = ("conv_id {0}, part int, segment long, blank long, duplicate long, truncated long, illegal long, "
               "first string, last string, ways " + SUMMARY)


def align_segments(found: DataFrame) -> DataFrame:
    kind = dict(found.dtypes)["conv_id"]

    def run(batches):
        for b in batches:
            codes, kinds = b.column("codes").to_pylist(), b.column("kinds").to_pylist()
            ways = [[{"p": p, "q": q, "cost": c, "audit": a} for p, q, c, a in aligned(x)] for x in codes]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("conv_id", "part", "segment", "blank", "duplicate", "truncated")]
                + [pa.array([broken_pairs(x) for x in kinds], pa.int64()), pa.array([x[0] for x in kinds], pa.string()),
                   pa.array([x[-1] for x in kinds], pa.string()),
                   pa.array(ways, pa.list_(pa.struct([("p", pa.int8()), ("q", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])))],
                ["conv_id", "part", "segment", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways"])

    return found.mapInArrow(run, SEGMENT_ROW.format(kind))


def join_neighbours(parts: DataFrame, key: list[str], order: str) -> DataFrame:
    """Joins the rows of each key, at most FAN_IN, in order."""
    kind = dict(parts.dtypes)["conv_id"]
    grouped = parts.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(order, "illegal", "first", "last", "ways"))).alias("held"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    def run(batches):
        for b in batches:
            held = b.column("held").to_pylist()
            illegal = [sum(x["illegal"] for x in h)
                       + sum(a["last"] + z["first"] not in ("su", "ua", "au") for a, z in zip(h, h[1:])) for h in held]
            ways = [joined(x["ways"] for x in h) for h in held]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in [*key, "blank", "duplicate", "truncated"]]
                + [pa.array(illegal, pa.int64()), pa.array([h[0]["first"] for h in held], pa.string()),
                   pa.array([h[-1]["last"] for h in held], pa.string()),
                   pa.array(ways, pa.list_(pa.struct([("p", pa.int8()), ("q", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])))],
                [*key, "blank", "duplicate", "truncated", "illegal", "first", "last", "ways"])

    keys = ", ".join(f"{c} {dict(grouped.dtypes)[c]}" for c in key)
    return grouped.mapInArrow(run, f"{keys}, blank long, duplicate long, truncated long, illegal long, "
                                   f"first string, last string, ways {SUMMARY}")


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation with turns."""
    spans = (turns.groupBy("conv_id", "turn").count().groupBy("conv_id").agg(
        F.expr("coalesce(max(turn) - min(turn) + 1 - count(turn), 0)").alias("gaps")))
    rows = materialize(align_segments(segments(turns)), "repair-segments")
    top = rows.agg(F.max("segment"), F.max("part")).first()
    for column, most in (("segment", top[0] or 0), ("part", top[1] or 0)):
        others = ["conv_id", "part"] if column == "segment" else ["conv_id"]
        while most > 0:
            rows = join_neighbours(rows.withColumn("up", F.expr(f"{column} div {FAN_IN}")), [*others, "up"], column)
            rows, most = rows.withColumnRenamed("up", column), most // FAN_IN
        rows = rows.drop(column)
    best = F.expr(f"array_min(transform(filter(ways, x -> x.p = {START} and x.q in ({START}, {BEHIND_A})),"
                  " x -> struct(x.cost, x.audit)))")
    found = rows.withColumn("best", best).select(
        "conv_id", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    return (found.join(spans.withColumnRenamed("conv_id", "_conv"), same(F.col("conv_id"), F.col("_conv")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


# ------------------------------------------------------------------ repaired turns

def in_order(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of each conversation, then its turns in order, all in one partition."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    lines = turns.select("conv_id", F.lit(1).alias("head"), "turn", role.alias("role"), text.alias("text"),
                         F.md5(text).alias("text_key"))
    heads = found.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"),
                         F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("text_key"))
    return (heads.unionByName(lines).repartition("conv_id")
            .sortWithinPartitions("conv_id", "head", "turn", "role", "text_key"))


def edits(audit: str):
    """(letter, role) of each edit; the role is that of the grammar string, None for D."""
    left = sum(c != "D" for c in audit)
    expected = "system" if left % 2 else "user"
    for c in audit:
        if c == "D":
            yield c, None
        else:
            yield c, expected
            expected = "assistant" if expected == "user" else "user"


class Repair:
    """Walks over the rows of `in_order` and gives (conv_id, position, edit, role, text) of repaired turns."""

    def __init__(self):
        self.conv, self.todo, self.at = None, None, 0

    def inserted(self, whole: bool):
        """The edits up to the next turn's own, or all that are left."""
        for letter, role in self.todo:
            if letter != "I":
                return letter, role
            self.out.append((self.conv, self.at, "I", role, ""))
            self.at += 1
        assert whole, "an audit ends before its turns"
        return None

    def row(self, conv, head, role, text):
        self.out = []
        if not head:
            self.conv, self.todo, self.at = conv, edits(text), 0
            return self.out
        letter, expected = self.inserted(False)
        if letter != "D":
            self.out.append((self.conv, self.at, letter, role if letter == "K" else expected, text))
            self.at += 1
        return self.out

    def end(self):
        self.out = []
        if self.todo is not None:
            self.inserted(True)
        return self.out


def walked(batches):
    """(conv_id, new conversation, repaired turns) for each row in order."""
    walk = Repair()
    for b in batches:
        columns = [b.column(c) for c in ("conv_id", "head", "role", "text")]
        for conv, head, role, text in zip(*[c.to_pylist() for c in columns]):
            if not head:
                yield walk.conv, False, walk.end()
            yield conv, not head, walk.row(conv, head, role, text)
    yield walk.conv, False, walk.end()


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit, role, text."""
    kind = dict(found.dtypes)["conv_id"]
    names = ["conv_id", "position", "edit", "role", "text"]
    types = [to_arrow_type(found.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = f"conv_id {kind}, position long, edit string, role string, text string"

    def run(batches):
        held: list = []
        for _, _, rows in walked(batches):
            held += rows
            if len(held) >= 1000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)

    return in_order(text_batches(turns), found).mapInArrow(run, schema)


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the repaired `role:text`, joined by newlines."""
    kind = dict(found.dtypes)["conv_id"]
    arrow = to_arrow_type(found.schema["conv_id"].dataType)

    def run(batches):
        ids, hashes = [], []
        for conv, new, rows in walked(batches):
            if new:
                ids.append(conv)
                hashes.append(hashlib.sha256())
            for _, at, _, role, text in rows:
                hashes[-1].update(("\n" if at else "").encode() + f"{role}:{text}".encode())
            if len(ids) > 1000:
                yield batch(ids[:-1], hashes[:-1])
                ids, hashes = ids[-1:], hashes[-1:]
        yield batch(ids, hashes)

    def batch(ids, hashes):
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow),
                                           pa.array([h.hexdigest() for h in hashes], pa.string())], ["conv_id", "repaired_sha256"])

    return in_order(text_batches(turns), found).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """`audits` and the digest of each repaired conversation."""
    turns = turns.select("conv_id", "turn", "role", "text")
    found = materialize(audits(turns), "repair-audits")
    hashed = digests(turns, found).withColumnRenamed("conv_id", "_conv")
    return found.join(hashed, same(F.col("conv_id"), F.col("_conv"))).drop("_conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with the faults that crc32(`conv_id:turn`) modulo 20 gives them; nulls are one space."""
    blank = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    return conversations.withColumn("_code", code).where("_code <> 0").select(
        "conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.expr("sequence(1, if(_code = 3, 2, 1))")).alias("_copy")).drop("_copy")


def repair_all(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """`repair` of the turns with a row for every conversation; those without turns have zeros."""
    every = conversations.select(F.col("conv_id").alias("_every")).distinct()
    found = repair(turns)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, same(F.col("_every"), F.col("conv_id")), "left").select(
        F.col("_every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
