"""Quotation linking: messages with nested quotes become reply-ordered conversations without quotes.

Bodies are parsed into own lines and quoted lines with their level.  Normalised lines are
hashed; a quoted line belongs to the latest earlier message of its thread that has the
line as its own, or else to the first message anywhere that has it.  Of the least level
that has lines with an original, the message with the most such lines, the latest of
these, is the parent: if the directly quoted message is missing, the nearest ancestor is.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import prefix_sums, salted_lookup

QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", re.S)
ATTRIBUTION = re.compile(r"^\s*(on\b.*\bwrote|am\b.*\bschrieb|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$", re.I)
PARSED = ("thread string, msg string, sent long, author string, text string, own array<long>, "
          "quoted array<struct<level: int, h: long>>")


def line_hash(line: str) -> int | None:
    """Hash of a line in lower case with single spaces; None for an empty one."""
    words = line.lower().split()
    if not words:
        return None
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parse_body(body: str | None) -> tuple[str, list[int], list[tuple[int, int]]]:
    """(text without quotes and attributions, hashes of its lines, (level, hash) of quoted lines)."""
    lines = (body or "").replace("\r\n", "\n").split("\n")
    parsed = []
    for line in lines:
        m = QUOTE.match(line)
        parsed.append((m[1].count(">"), m[2]) if m else (0, line))
    own, quoted = [], []
    for i, (level, line) in enumerate(parsed):
        if level:
            h = line_hash(line)
            if h is not None:
                quoted.append((level, h))
        elif not (ATTRIBUTION.match(line) and next((p[0] for p in parsed[i + 1:] if p[0] or p[1].strip()), 0)):
            own.append(line)
    while own and not own[-1].strip():
        own.pop()
    while own and not own[0].strip():
        own.pop(0)
    hashes = sorted({h for h in map(line_hash, own) if h is not None})
    return "\n".join(own), hashes, quoted


def parse_rows(batches):
    schema = pa.schema([("thread", pa.string()), ("msg", pa.string()), ("sent", pa.int64()), ("author", pa.string()),
                        ("text", pa.string()), ("own", pa.list_(pa.int64())),
                        ("quoted", pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64())])))])
    for b in batches:
        rows = b.to_pylist()
        for at in range(0, len(rows), 2000):
            out = []
            for r in rows[at:at + 2000]:
                text, own, quoted = parse_body(r.pop("body"))
                out.append(r | {"text": text, "own": own, "quoted": [{"level": x, "h": h} for x, h in quoted]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def latest_own(lines: DataFrame) -> DataFrame:
    """For each quoted line (is_quote) the latest earlier message of its thread with the line as its own.

    As-of lookup without a join on the line: lines are dealt by ranges of (line, time); a
    small table carries the last message of each range into the next ones, so a line that
    very many messages of one thread share is spread like any other.
    """
    spark = lines.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at one time quotes come before own lines: a message does not quote itself
    dealt = materialize(lines.repartitionByRange(parts, "line", "sent", "is_own", "msg")
                        .withColumn("_range", F.spark_partition_id()), "quote-lines")
    own = "case when is_own = 1 then struct(sent, msg) end"
    last = dealt.groupBy("line", "_range").agg(F.max(F.expr(own)).alias("_last"))
    carried = last.select("line", "_range", F.expr(
        "max(_last) over (partition by line order by _range rows between unbounded preceding and 1 preceding)").alias("_carried"))
    inside = F.expr(f"max({own}) over (partition by line, _range order by sent, is_own rows between unbounded preceding and current row)")
    return (dealt.withColumn("_inside", inside).where("is_own = 0").join(carried, ["line", "_range"])
            .withColumn("to", F.coalesce("_inside", "_carried")).select("key", "thread", "msg", "sent", "level", "h", "to"))


def parents(parsed: DataFrame) -> DataFrame:
    """(key, parent, linked): the parent's key, and how many quoted lines of its level were linked to it."""
    line = F.xxhash64(F.coalesce("thread", F.lit("")), F.col("thread").isNull(), F.col("h")).alias("line")
    quotes = (parsed.select("key", "thread", "msg", "sent", F.explode("quoted").alias("q"))
              .groupBy("key", "thread", "msg", "sent", F.col("q.h").alias("h")).agg(F.min("q.level").alias("level")))
    own = parsed.select("key", "thread", "msg", "sent", F.explode("own").alias("h"), F.lit(0).alias("level"))
    both = (quotes.withColumn("is_own", F.lit(0)).unionByName(own.withColumn("is_own", F.lit(1)))
            .select("*", line))
    near = materialize(latest_own(both), "quote-near")
    first = own.groupBy("h").agg(F.min(F.struct("sent", "thread", "msg")).alias("first"))
    far = salted_lookup(near.where("to is null").select("key", "thread", "msg", "sent", "level", "h"),
                        first.join(near.where("to is null").select("h").distinct(), "h", "left_semi"), ["h"])
    far = far.where("first is not null and not (first.thread <=> thread) and first.sent <= sent")
    target = lambda t, m: F.xxhash64(F.coalesce(t, F.lit("")), t.isNull(), m)
    votes = (near.where("to is not null").select("key", "level", F.col("to.sent").alias("at"),
                                                 target(F.col("thread"), F.col("to.msg")).alias("parent"))
             .unionAll(far.select("key", "level", F.col("first.sent").alias("at"),
                                  target(F.col("first.thread"), F.col("first.msg")).alias("parent"))))
    best = (votes.where("key <> parent").groupBy("key", "level", "parent").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
            .groupBy("key").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "at", "parent")).alias("b"))
            .select("key", F.col("b.parent").alias("parent"), F.col("b.n").cast("int").alias("linked")))
    return best


def reply_depths(links: DataFrame) -> DataFrame:
    """(key, root, depth) of every message from (key, parent), by pointer doubling.

    Only messages that have not reached their root take part in a round.  A parent was
    sent before its reply, or in another thread at the same time; a ring of such links is
    cut after as many rounds as a chain of 2**40 replies would need.
    """
    step = materialize(links.select("key", F.coalesce("parent", "key").alias("up"),
                                    F.col("parent").isNotNull().cast("long").alias("depth"),
                                    F.col("parent").isNull().alias("done")), "replies")
    for _ in range(40):
        if step.where("not done").isEmpty():
            break
        above = step.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"),
                            F.col("done").alias("there"))
        moved = step.where("not done").join(above, "up").select(
            "key", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        step = materialize(step.where("done").unionByName(moved), "replies")
    return step.select("key", F.col("up").alias("root"), "depth")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations of `messages` (thread, msg, sent, author, body).

    Returns thread, msg, author, text (without quotes), parent_thread, parent, root,
    depth, position (from 1 in the conversation: by depth, sent, thread, msg), quoted
    (quoted lines) and linked (lines that chose the parent).

    One row per (thread, msg); of repeated ones the first by sent, then body, counts.  A
    null thread is a thread, a null sent is 0, a null msg "".  A null or empty body has no
    text and no quotes.  Quoted lines without an original link to nothing.  An empty
    table gives an empty result.
    """
    rows = (messages.select(F.col("thread").cast("string").alias("thread"), F.coalesce(F.col("msg").cast("string"), F.lit("")).alias("msg"),
                            F.coalesce(F.col("sent").cast("long"), F.lit(0)).alias("sent"),
                            F.struct(F.coalesce(F.col("sent").cast("long"), F.lit(0)).alias("sent"), F.col("body").cast("string").alias("body"),
                                     F.col("author").cast("string").alias("author")).alias("m"))
            .groupBy("thread", "msg").agg(F.min("m").alias("m")).select("thread", "msg", "m.sent", "m.author", "m.body"))
    key = F.xxhash64(F.coalesce("thread", F.lit("")), F.col("thread").isNull(), F.col("msg"))
    parsed = materialize(rows.mapInArrow(parse_rows, PARSED).withColumn("key", key), "messages")
    linked = materialize(parsed.select("key").join(parents(parsed), "key", "left"), "message-parents")
    tree = reply_depths(linked)
    out = parsed.drop("own").join(linked, "key").join(tree, "key")
    slim = out.select("key", "root", "depth", "sent", "thread", "msg", F.lit(1).alias("one"))
    place = prefix_sums(slim, "root", ["depth", "sent", "thread", "msg"], "one", "before").select(
        "key", (F.col("before") + 1).alias("position"))
    names = parsed.select(F.col("key").alias("parent"), F.col("thread").alias("parent_thread"), F.col("msg").alias("parent_msg"))
    roots = parsed.select(F.col("key").alias("root"), F.concat_ws("/", "thread", "msg").alias("root_msg"))
    return (out.join(place, "key").join(names, "parent", "left").join(roots, "root", "left")
            .select("thread", "msg", "author", "text", "parent_thread", F.col("parent_msg").alias("parent"),
                    F.col("root_msg").alias("root"), "depth", "position", F.size("quoted").alias("quoted"),
                    F.coalesce("linked", F.lit(0)).alias("linked")))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as mail: every turn quotes the one before, and that one's quote a level deeper.

    Turns are found by their number in their own conversation, so a missing turn is not quoted.
    """
    turn = conversations.select("conv_id", "turn", "role", "text")
    quoted = lambda text, mark: F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))

    def earlier(k, name):
        return (conversations.groupBy("conv_id", (F.col("turn") + k).alias("turn"))
                .agg(F.min(F.struct("text", "role")).alias("t"))
                .select("conv_id", "turn", F.col("t.text").alias(name), F.col("t.role").alias(f"{name}_role")))

    body = F.concat_ws(
        "\n", F.when(F.col("one").isNotNull(), F.concat(F.lit("On turn "), F.col("turn") - 1, F.lit(", "), F.coalesce("one_role", F.lit("someone")), F.lit(" wrote:"))),
        F.when(F.col("two").isNotNull() & F.col("one").isNotNull(), quoted(F.col("two"), ">> ")),
        quoted(F.col("one"), "> "), F.lit(""), F.col("text"))
    return (turn.join(earlier(1, "one"), ["conv_id", "turn"], "left").join(earlier(2, "two"), ["conv_id", "turn"], "left")
            .select(F.col("conv_id").alias("thread"), F.col("turn").alias("msg"), F.col("turn").alias("sent"),
                    F.col("role").alias("author"), body.alias("body")))
