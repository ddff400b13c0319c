"""Secret scanning on DataFrame functions only, with a random forest that removes false positives.

Candidates are values assigned to a credential name (in any case, with a prefix, spaces
and quotes; up to the quote or white space), runs of 12 key-like characters with a digit
or 20 without, and keys of known formats.  Each is described by its length, its character
classes and the transitions between them, how much of it dictionary words cover,
whether it stands in a path or an address, and the words around it.  A random forest
(pyspark.ml) over labelled findings scores it.
"""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MARK = "\u0001"
#: A credential name with what is around it and a sign of assignment (group 1), then its value without the full stop
#: or comma of a sentence (2); or a run of key characters that has a digit or is long (3).
CANDIDATE = (r"((?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{0,60}?"
             r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
             r"[A-Za-z0-9_\-]{0,20}[\"']?[ \t]{0,4}(?:=>|:=|[=:])[ \t]{0,4}[\"']?)([^\s\"']{5,}[^\s\"'.,;])"
             r"|(?<![A-Za-z0-9+/_\-])((?:(?=[A-Za-z+/_\-]{0,80}[0-9])[A-Za-z0-9+/_\-]{12,}|[A-Za-z0-9+/_\-]{20,})={0,2})")
MARKED = f"$1{MARK}$2$3{MARK}"
KNOWN = [("aws_key", r"^AKIA[0-9A-Z]{16}$"), ("github_token", r"^gh[pousr]_[A-Za-z0-9]{36}$"),
         ("slack_token", r"^xox[abprs]-"), ("google_key", r"^AIza[0-9A-Za-z_\-]{35}$")]
#: Words that make a candidate look written by a person.
DICTIONARY = ["example", "sample", "dummy", "test", "demo", "your", "here", "change", "placeholder", "password",
              "secret", "token", "value", "name", "user", "admin", "default", "config", "index", "image", "page",
              "article", "content", "version", "release", "build", "service", "server", "client", "data", "file",
              "report", "model", "class", "null", "true", "false", "none", "item", "list", "order", "number"]
NEAR = {"credential": r"(?i)pass(word|wd|phrase)?\b|secret|token|api_?key|access|auth|bearer|credential",
        "digest": r"(?i)\bsha|md5|commit|checksum|digest|etag|hash|revision",
        "identifier": r"(?i)uuid|guid|request|trace|order|invoice|serial|\bid\b",
        "pretend": r"(?i)example|sample|dummy|placeholder|redacted",
        "address": r"(?i)https?:|www\.|\bmailto|://"}


def findings(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., parts, finding, candidate, before, after): one row per candidate of each text, in order.

    The text is cut at its candidates, so `parts` at odd places are the candidates and
    all parts together are the text.  A mark character that a text has itself is a space.
    """
    text = F.translate(F.col("text"), MARK, " ")
    cut = F.split(F.regexp_replace(text, CANDIDATE, MARKED), MARK)
    places = F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2))
    return (docs.where(F.col("text").rlike(CANDIDATE)).select(*keep, cut.alias("parts"))
            .where(F.size("parts") >= 3)
            .select(*keep, "parts", F.explode(F.transform(places, lambda i: F.struct(
                i.alias("place"), F.get("parts", i).alias("candidate"),
                F.right(F.get("parts", i - 1), F.lit(40)).alias("before"),
                F.left(F.get("parts", i + 1), F.lit(24)).alias("after")))).alias("f"))
            .select(*keep, "parts", (F.expr("cast((f.place + 1) / 2 as int)")).alias("finding"),
                    "f.candidate", "f.before", "f.after"))


def share(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)) / F.length(column)


def described(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the features of candidate, before and after; their names."""
    c = F.col("candidate")
    turns = ("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    words = "(?i)" + "|".join(DICTIONARY)
    columns = {
        "f_length": F.length(c).cast("double"), "f_digits": share("candidate", "[0-9]"),
        "f_upper": share("candidate", "[A-Z]"), "f_lower": share("candidate", "[a-z]"),
        "f_signs": share("candidate", "[^A-Za-z0-9]"), "f_turns": share("candidate", turns),
        "f_hex": c.rlike("^[0-9a-f]+$").cast("double"), "f_uuid": c.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-").cast("double"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "f_words": 1 - F.length(F.regexp_replace(c, words, "")) / F.length(c),
        "f_vowels": share("candidate", "(?i)[aeiou]"),
        "f_path": (F.col("before").rlike(r"[/\\][^\s]*$") | F.col("after").rlike(r"^[^\s]*[/\\]|^\.[a-z]{2,4}\b")
                   | (F.regexp_count(c, F.lit("/")) >= 2)).cast("double"),
        "f_mail": (F.col("after").rlike(r"^[\w.\-]*@") | F.col("before").rlike(r"@[\w.\-]*$")).cast("double"),
        "f_assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "f_known": (F.greatest(*[c.rlike(p).cast("int") for _, p in KNOWN])).cast("double"),
    }
    for name, pattern in NEAR.items():
        columns[f"f_{name}"] = F.col("before").rlike(pattern).cast("double")
    columns["f_pretend"] = (F.col("before").rlike(NEAR["pretend"]) | c.rlike(NEAR["pretend"])
                            | c.rlike(r"(.)\1{5}")).cast("double")
    return rows.select("*", *[v.cast("double").alias(k) for k, v in columns.items()]), list(columns)


def train(labelled: DataFrame, trees: int = 20, depth: int = 7, seed: int = 9) -> RandomForestClassificationModel:
    """A forest from labelled findings: rows of (text, label 0/1), the label holding for every candidate in the text.

    Null texts and labels are ignored.  Raises ValueError if no candidate is labelled.
    """
    rows, names = described(findings(labelled.where("text is not null and label is not null"), ["label"]))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.drop("parts"))
    if rows.isEmpty():
        raise ValueError("there are no labelled findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label",
                                  featureSubsetStrategy="sqrt").fit(rows.select("label", "features"))


def scan(docs: DataFrame, forest: RandomForestClassificationModel, keep: tuple[str, ...] = ("doc_id",),
         threshold: float = 0.5) -> DataFrame:
    """Every candidate of every whole text with the forest's score.

    Returns the columns `keep`, finding (1, 2, ... in a text), kind, candidate, masked,
    digest (SHA-256), before, after, score (0 to 1), is_secret.  Repeated rows and null
    ids are kept as they are; null, empty and candidate-free texts give no row, an empty
    table an empty result.  Other columns are ignored.
    """
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text"))
    own = [f"k{i}" for i in range(len(keep))]
    rows, names = described(findings(slim, own).drop("parts"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    scored = forest.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    kind = F.coalesce(*[F.when(F.col("candidate").rlike(p), F.lit(k)) for k, p in KNOWN],
                      F.when(F.col("f_credential") == 1, F.lit("assigned")), F.lit("generic"))
    return scored.select(
        *[F.col(k).alias(c) for k, c in zip(own, keep)], "finding", kind.alias("kind"), "candidate",
        F.concat(F.left("candidate", F.lit(4)), F.lit("…"), F.length("candidate").cast("string")).alias("masked"),
        F.sha2("candidate", 256).alias("digest"), "before", "after", "score",
        (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """`docs` with each secret in text replaced by [SECRET]; n_chars, if there, follows; rows and columns stay.

    Each candidate is judged where it stands.  Only texts with a candidate are looked up
    (by a hash of the text); all others pass as they are.  Other columns may have any name.
    """
    suspect = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    key, secret = fresh("_text_key", docs.columns), fresh("_secret", docs.columns)
    keyed = docs.where(suspect).withColumn(key, F.xxhash64("text"))
    found = (scan(keyed.select(key, "text").dropDuplicates([key]), forest, (key,), threshold)
             .where("is_secret").groupBy(key).agg(F.collect_set("finding").alias(secret)))
    cut = F.split(F.regexp_replace(F.translate(F.col("text"), MARK, " "), CANDIDATE, MARKED), MARK)
    clean = F.array_join(F.transform(cut, lambda x, i: F.when(
        (i % 2 == 1) & F.array_contains(secret, ((i + 1) / 2).cast("int")), F.lit("[SECRET]")).otherwise(x)), "")
    hit = F.col(secret).isNotNull()
    out = keyed.join(found, key, "left").withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.when(hit, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(dict(docs.dtypes)["n_chars"]))
    return docs.where(~suspect).unionByName(out.select(*docs.columns))


#: (label, template) of labelled findings: {h} hex, {u} capitals and digits, {b} letters and digits,
#: {a} letters, {d} digits, {w} a word.
TEMPLATES = [
    (1, "password={h18}"), (1, 'token = "{h40}"'), (1, "AKIA{u16}"), (1, "secret: {b32}"), (1, "api_key={b24}"),
    (1, "Authorization: Bearer {b40}"), (1, 'password: "{b14}"'), (1, "ghp_{b36}"), (1, "{w} AKIA{u16} {w}"),
    (1, 'password: "{a19}"'), (1, "DB_PASSWORD={a20}"), (1, 'api_key = "{a24}"'), (1, "Password={a6}{d2}x"), (1, 'password: "{a2}{d2}{a2}{d2}"'),
    (1, "password={u1}@{a4}{d1}{a2}!"), (1, 'password: "{w}{w}{w}"'), (1, "ADMIN_PASSWORD={w}{w}{w}"),
    (0, "commit {h40}"), (0, "sha256:{h64}"), (0, "md5 {h32}"), (0, "/assets/app.{h20}.js"), (0, "request id {h8}-{h4}-{h4}-{h4}-{h12}"),
    (0, "{w}.{d2}@mail{d1}.example.com"), (0, "https://{w}.example.com/{w}/{h24}"), (0, 'token = "your-token-{d4}-here"'),
    (0, "order number {d16}"), (0, "password=xxxxxxxxxxx{d1}"), (0, "example secret: sample-value-{d6}"), (0, "{w}{w}{w}{d4}"),
    (0, "{w}_{w}_{w}_v{d2}"), (0, "2024-{d2}-{d2}T{d2}-{d2}-{d2}"), (0, "+{d2}-{d3}-{d3}-{d4}"),
    (0, "{w}-{w}-{w}-{w}-{w}-{w}"), (0, "/{w}/{w}/{w}/{w}/{w}"), (0, "{w}_{w}_{w}_{w}_{w}_{w}"), (0, "--------------------------------"),
    (0, "{w}{w}{w}{w}{w}{w}"), (0, "token: {w}"), (0, "secret: {w}"), (0, "password: changeme-example"), (0, "password=<your-password>")]


def drawn(kind: str, n: int, salt: str) -> Column:
    """n characters of a kind that depend on the document and the salt alone."""
    digest = F.concat(*[F.sha2(F.concat(F.col("seed"), F.lit(f"{salt}{i}")), 256) for i in range(-(-n // 40))])
    if kind == "h":
        return F.left(digest, F.lit(n))
    if kind == "d":
        return F.left(F.translate(digest, "abcdef", "012345"), F.lit(n))
    if kind == "a":
        return F.left(F.translate(digest, "0123456789", "ghijkmnpqr"), F.lit(n))
    packed = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=\\s]", "x")
    return F.left(F.upper(F.translate(packed, "0189", "2345")) if kind == "u" else packed, F.lit(n))


def labelled_findings(docs: DataFrame, rows: int = 400) -> DataFrame:
    """(text, label): known secrets and known harmless strings set between words of about `rows` documents.

    The strings are made from hashes of the documents' ids by templates of either label,
    their surroundings are the documents' own words; `rows`, chosen by a hash of the id,
    bounds the sample.  Without documents with text, one made of template words is used.
    """
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    total = texts.count()
    pick = F.pmod(F.xxhash64(F.lit(23), F.col("doc_id")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(total, 1)))
    own = texts.where(pick).select(F.col("doc_id").cast("string").alias("seed"),
                                   F.slice(F.split(F.regexp_replace("text", "[^\\p{L}\\s]", ""), "\\s+"), 1, 30).alias("w"))
    made = docs.sparkSession.createDataFrame([(f"own{i}", DICTIONARY[:30]) for i in range(20)], "seed string, w array<string>")
    base = own.where("size(w) >= 12").unionAll(made)
    lines = []
    for n, (label, template) in enumerate(TEMPLATES):
        parts, rest, k = [], template, 0
        while "{" in rest:
            head, _, tail = rest.partition("{")
            spec, _, rest = tail.partition("}")
            k += 1
            word = F.lower(F.coalesce(F.try_element_at("w", F.lit(6 + (n + k) % 6)), F.lit("word")))
            parts += [F.lit(head), word if spec == "w" else drawn(spec[0], int(spec[1:]), f"-{n}-{k}-")]
        lines.append(F.struct(F.concat(F.array_join(F.slice("w", 1 + n % 4, 4), " "), F.lit(" "), *parts, F.lit(rest + " "),
                                       F.array_join(F.slice("w", 8, 4), " ")).alias("text"), F.lit(label).alias("label")))
    return base.select(F.explode(F.array(*lines)).alias("x")).select("x.text", "x.label")
