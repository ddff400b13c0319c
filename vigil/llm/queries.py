"""Registered queries of the numbered operators and their DuckDB SQL."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, packing, pst, repair, runs, secrets, toxicity, warc
from .common import held_out, read
from .mixing import mix
from .near_dedup import near_duplicates
from .topk import exact_top_k

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLES["op2_exact_top_k"] = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def quality_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weight per labelled document: good ones 2, poor ones a half."""
    return (read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id")
            .agg(F.expr("case max(quality) when 1 then 2.0D when 0 then 0.5D end").alias("weight")))


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return (mix(docs, quality=quality_of(spark, sf_dir))
            .select("doc_id", "size", "source_size", "target", "taken"))


ORACLES["op6_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
quality AS (
  SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END AS weight
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT s.*, -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
      + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(CAST(q.weight AS DOUBLE), 1.0::DOUBLE) AS key
  FROM sized s LEFT JOIN quality q ON s.doc_id = q.doc_id),
placed AS (
  SELECT source, source_size,
    CAST(CASE ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3
         WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
filled AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    sum(3.0::DOUBLE * source_size) OVER w - 3.0::DOUBLE * source_size AS used,
    sum(weight) OVER () - sum(weight) OVER w + weight AS open,
    sum(source_size) OVER () AS total
  FROM placed
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT (total - used) / open AS level FROM filled
  WHERE (total - used) / open * weight <= cap
  ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * (SELECT level FROM level), cap) AS target FROM filled),
summed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    coalesce(CAST(floor(round(t.target) / nullif(t.source_size, 0)) AS BIGINT), 0) AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM summed
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn(
        "held_out", held_out(F.col("doc_id"), 3, 1))
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


@query
def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn(
        "held_out", held_out(F.col("doc_id"), 7, 2))
    return pst.score(docs, pst.train(docs.where("not held_out")))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (warc.round_trip(read(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLES["op7_warc"] = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (
  SELECT payload_digest, max(page_id) AS first_id FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest),
seen AS (
  SELECT p.*, f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id AS again, f.first_id
  FROM payloads p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM seen
"""


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


ORACLES["op8_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
lowest AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn(
        "held_out", held_out(F.col("doc_id"), 5, 0))
    labels = (read(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id")
              .agg(F.max("toxic").alias("label")))
    return toxicity.toxicity(docs, docs.where("not held_out").join(labels, "doc_id"))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items: one row per pair."""
    return (decontam.contained_items(read(spark, sf_dir, "documents", "doc_id", "text"),
                                     read(spark, sf_dir, "benchmark"))
            .groupBy("doc_id", "item_id").agg(F.max("item_shingles").alias("item_shingles"),
                                              F.max("matched").alias("matched")))


ORACLES["op1_decontaminate"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
items AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k,
    unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM iw WHERE len(w) > 0),
docs AS (
  SELECT DISTINCT doc_id, k,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw, widths WHERE len(w) >= k),
sizes AS (SELECT item_id, CAST(count(*) AS BIGINT) AS item_shingles FROM items GROUP BY item_id),
hits AS (
  SELECT d.doc_id, i.item_id, CAST(count(*) AS BIGINT) AS matched
  FROM docs d JOIN items i ON d.s = i.s AND d.k = i.k GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, matched FROM hits JOIN sizes USING (item_id)
WHERE 10 * matched >= 8 * item_shingles
"""


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in the documents with the forest's score."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    forest = secrets.train(secrets.labelled_findings(docs))
    return (secrets.scan(docs, forest)
            .select("doc_id", "finding", "kind", "masked", "digest", "score", "is_secret"))


@query
def op3_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent as mail that quotes the turns before, read back as conversations."""
    linked = chat.link_quotations(chat.as_messages(read(spark, sf_dir, "conversations")))
    return linked.select(
        F.col("thread").cast("long").alias("conv_id"), F.col("msg").cast("long").alias("turn"), "author", "text",
        F.col("parent_thread").cast("long").alias("parent_conv"), F.col("parent").cast("long").alias("parent_turn"),
        "depth", "position", "quoted", "linked")


ORACLES["op3_quotations"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role AS author,
    regexp_replace(regexp_replace(coalesce(text, ''), '^(\s*\n)+', ''), '(\n\s*)+$', '') AS text,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
      lambda x: array_to_string(regexp_extract_all(lower(x), '\S+'), ' ')), lambda x: x <> '') AS lines
  FROM conversations),
pairs AS (
  SELECT t.*, p.turn AS parent_turn, len(list_distinct(p.lines)) AS linked, len(p.lines) + coalesce(len(g.lines), 0) AS quoted
  FROM turns t
  LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1 AND len(p.lines) > 0
  LEFT JOIN turns g ON p.turn IS NOT NULL AND g.conv_id = t.conv_id AND g.turn = t.turn - 2),
runs AS (
  SELECT *, max(CASE WHEN parent_turn IS NULL THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS root FROM pairs)
SELECT conv_id, turn, author, text, CASE WHEN parent_turn IS NOT NULL THEN conv_id END AS parent_conv, parent_turn,
  turn - root AS depth, turn - root + 1 AS position, CAST(coalesce(quoted, 0) AS INTEGER) AS quoted,
  CAST(coalesce(linked, 0) AS INTEGER) AS linked
FROM runs
"""


@query
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.repair_all(conversations, repair.damaged(conversations))


#: CRC-32 of a short ASCII text, byte by byte and bit by bit.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x // 2, (x % 2) * 3988292384))), 4294967295::BIGINT)"""

#: Each state of the grammar (nothing, s, u, a) holds its cheapest way as cost in nine digits and audit.
ORACLES["op11_repair_conversations"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
coded AS (SELECT *, {crc} % 20 AS code FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
lined AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM turns),
seen AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    left(role, 1) AS i, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair
  FROM lined),
faulty AS (SELECT *, fault IS NOT NULL AND fault <> 'truncated' AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
ways AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS pos, '000000000' AS v0, NULL::VARCHAR AS vs, '000000003I' AS vu, '000000006II' AS va FROM counts
  UNION ALL
  SELECT conv_id, n, pos, w0, ws, wu, least(wa, {i:wu}) FROM (
    SELECT conv_id, n, pos, w0, ws, least(wu, {i:w0}, {i:ws}, {i:wa}) AS wu, wa FROM (
      SELECT w.conv_id, w.n, w.pos + 1 AS pos, {d:v0} AS w0,
        least({d:vs}, CASE WHEN NOT gone AND i = 's' THEN {k:v0} END) AS ws,
        least({d:vu}, CASE WHEN gone THEN NULL WHEN i = 'u' THEN least({k:v0}, {k:vs}, {k:va}) ELSE least({r:v0}, {r:vs}, {r:va}) END) AS wu,
        least({d:va}, CASE WHEN gone THEN NULL WHEN i = 'a' THEN {k:vu} ELSE {r:vu} END) AS wa
      FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1))),
best AS (
  SELECT conv_id, CAST(left(least(v0, va), 9) AS BIGINT) AS cost, substr(least(v0, va), 10) AS audit
  FROM ways WHERE pos = n),
letters AS (
  SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best),
placed AS (
  SELECT conv_id, p, substr(audit, p, 1) AS c, len(replace(substr(audit, 1, p), 'I', '')) AS pos,
    len(replace(substr(audit, 1, p), 'D', '')) AS o, len(replace(audit, 'D', '')) % 2 AS odd
  FROM letters),
texts AS (
  SELECT p.conv_id, string_agg(CASE WHEN c = 'K' THEN f.role WHEN (o + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN c = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS whole
  FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos
  WHERE c <> 'D' GROUP BY p.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _with_edits(sql: str) -> str:
    """Fills in {letter:way}: the way with that edit behind it and its cost added."""
    cost = {"d": "4", "k": "extra", "r": "3 + extra", "i": "3"}
    return re.sub(r"\{([dkri]):(\w+)\}", lambda m: (
        f"lpad(CAST(CAST(left({m[2]}, 9) AS BIGINT) + {cost[m[1]]} AS VARCHAR), 9, '0') || substr({m[2]}, 10) || '{m[1].upper()}'"),
        sql.replace("{crc}", CRC32_SQL.format("k")))


ORACLES["op11_repair_conversations"] = _with_edits(ORACLES["op11_repair_conversations"])


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return runs.digests(runs.periodic_runs(runs.made_periodic(docs)))


#: A run of 12 words or more holds a stretch of equal six-word pieces a period apart; stretches
#: inside a run of a smaller period have not their smallest one.
ORACLES["op12_periodic_runs"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(CAST(doc_id AS VARCHAR), '') AS k
  FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN {crc} END AS h FROM split),
placed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 % 8 AS m FROM hashed),
texts AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n),
      lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END]) END AS w
  FROM placed),
grams AS (SELECT r, unnest(range(0, n - 5)) AS i, w FROM texts WHERE n >= 6),
pieces AS (SELECT r, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5], w[i + 6]) AS g FROM grams),
pairs AS (
  SELECT x.r, x.i, y.i - x.i AS d FROM pieces x JOIN pieces y ON x.r = y.r AND x.g = y.g AND y.i > x.i),
stretches AS (SELECT *, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS s FROM pairs),
found AS (
  SELECT r, d AS q, min(i) AS start, max(i) + 6 + d - min(i) AS length FROM stretches GROUP BY r, d, s
  HAVING max(i) + 6 + d - min(i) >= greatest(12, 2 * d)),
runs AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.r = f.r AND o.q < f.q AND o.start <= f.start AND o.start + o.length >= f.start + f.length)),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
    max(struct_pack(l := length, s := -start, p := -q)) AS top
  FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
gone AS (SELECT r, list(i) AS gone FROM dropped GROUP BY r)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, -top.s AS start, top.l AS length, -top.p AS period,
  1000 * top.l // -top.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (r) LEFT JOIN gone USING (r)
""".replace("{crc}", CRC32_SQL.format("k"))


def word_bpe() -> str:
    """Path of the public tokenizer of op13, looked up where it is used."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(read(spark, sf_dir, "documents", "doc_id", "text"), word_bpe, keep_ids=False)
    return packing.pack(found, ["doc_id", "piece", "ids_crc32"])
