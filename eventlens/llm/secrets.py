"""Secret scan (operator 1), native: wide proposals, then a random forest
removes false positives.

Proposals are tokens of at least 16 characters that hold a digit, web tokens
(``eyJ....``) as one piece, and values assigned to a telling name
(``password=...``, ``AWS_ACCESS_KEY_ID=...``). Tokens start anywhere but
inside a run of token characters: after ``=`` and ``.``, in URLs and in
assigned values too; of a token with slashes each part that is long enough is
proposed as well. Of proposals inside one another that the forest keeps, the
outermost is the finding. Features of a proposal: its
length, its character transitions, how much of it dictionary words cover,
whether it reads like a path or part of a URL, and the words beside it. The
forest (MLlib) is trained from labelled findings: a table (text, label) where
the first proposal of ``text`` is the finding, or the one equal to ``finding``
if there is such a column. ``seed_findings`` gives the findings used by
default; a user's own are added to them.

The dictionary is made from all documents: letter runs that occur in at least
``MIN_WORD_DOCS`` of them, of which only those in proposals are looked up.

Defined results: null text counts as empty; a repeated row gives its findings
again (redaction treats each row by its own text); an empty table gives no
finding; offsets are code points, end exclusive; null ids are kept. Other
columns are not read.
"""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import shared_path, written
from eventlens.llm.spans import regex_spans

PADDING = r"(?:={1,2}+(?![A-Za-z0-9_/+=-]))?+"
TOKEN = (r"(?<![A-Za-z0-9_/+-])(?:eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){1,4}(?![A-Za-z0-9_/+-])"
         r"|(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+" + PADDING + ")")
SEGMENT = r"(?<![A-Za-z0-9_+-])(?=[A-Za-z_+-]*+[0-9])[A-Za-z0-9_+-]{16,}+" + PADDING
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
#: What may follow a telling name: a plural, then _ID, .key, digits, or a further word in camel case.
SUFFIX = r"s?+(?:(?:[0-9_.-]|(?-i:(?<=[a-z])[A-Z]))[a-z0-9_.-]*+)?+"
HEAD = NAMES + SUFFIX + r"[\"']?+[\x20]{0,2}+[:=][\x20]{0,2}+[\"']?+"
ASSIGNED = "(?i)" + HEAD + r"[^\s\"'<>,;]{6,}+"
NEAR_NAMES = r"(?i)\b" + NAMES + r"\b|" + NAMES + SUFFIX + r"[\"']?\s*[:=]"
NEAR_HARMLESS = r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|uuid|build|version|revision|etag|request|session|example|image|file|isbn|order|hash)\b"
FEATURES = ["length", "digits", "uppers", "transitions", "hex_only", "distinct_share", "dictionary_share",
            "path_marks", "in_url", "assigned", "name_before", "harmless_before", "name_after"]
CONTEXT_CHARS = 32
MIN_WORD_DOCS = 3
THRESHOLD = 0.5
SEEDS_PER_SHAPE = 50
TREES, DEPTH, SEED = 40, 6, 42


def _proposals(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (keys, text) with one row per proposal: start, end,
    value, assigned and the text around it. Two proposals are disjoint, or one
    holds the other. Rows without any are left out."""
    text = F.col("text")
    plain = regex_spans(text, TOKEN, text.rlike("[0-9]|eyJ"))
    parts = regex_spans(text, SEGMENT, F.exists("plain", lambda p: F.contains(p["value"], F.lit("/"))))
    named = F.transform(regex_spans(text, ASSIGNED, text.rlike("(?i)" + HEAD)), lambda s: F.struct(
        (s["end"] - F.length(F.regexp_replace(s["value"], "(?i)^" + HEAD, ""))).alias("start"), s["end"].alias("end"),
        F.regexp_replace(s["value"], "(?i)^" + HEAD, "").alias("value")))
    rows = docs.withColumn("named", named).withColumn("plain", plain).withColumn("parts", parts)
    free = F.array_except(F.array_union("plain", "parts"), "named")
    mark = lambda spans, flag: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(flag).alias("assigned")))
    rows = rows.withColumn("found", F.explode(F.concat(mark(F.col("named"), 1.0), mark(free, 0.0))))
    first = F.greatest(F.col("found.start") - CONTEXT_CHARS, F.lit(0))
    return rows.select(
        *[c for c in docs.columns if c != "text"], "found.start", "found.end", "found.value", "found.assigned",
        F.substring("text", (first + 1).cast("int"), (F.col("found.start") - first).cast("int")).alias("before"),
        F.substring("text", (F.col("found.end") + 1).cast("int"), F.lit(CONTEXT_CHARS)).alias("after"))


def _share(part: Column) -> Column:
    return part / F.greatest(F.length("value"), F.lit(1))


def _kept(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, ""))


def _features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Feature columns; ``found`` needs a ``proposal`` key. Dictionary words
    are joined to the letter runs of the proposals."""
    runs = found.select("proposal", F.explode(F.filter(
        F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= 3)).alias("word"))
    covered = (runs.join(words, "word").groupBy("proposal").agg(F.sum(F.length("word")).alias("covered")))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "value", "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), "[^0aA]+", "-")
    return found.join(covered, "proposal", "left").withColumns({
        "length": F.length("value").cast("double"),
        "digits": _share(_kept("[^0-9]")),
        "uppers": _share(_kept("[^A-Z]")),
        "transitions": _share(F.length(classes) - 1),
        "hex_only": F.col("value").rlike("^[0-9a-fA-F]+$").cast("double"),
        "distinct_share": _share(F.size(F.array_distinct(F.split("value", "")))),
        "dictionary_share": _share(F.coalesce("covered", F.lit(0))),
        "path_marks": _share(_kept("[^/._-]")),
        "in_url": (F.col("before").rlike(r"(?i)(?:https?:|www\.|/)\S*$") | F.col("after").rlike(r"^[/.@]\w")).cast("double"),
        "name_before": F.col("before").rlike(NEAR_NAMES).cast("double"),
        "harmless_before": F.col("before").rlike(NEAR_HARMLESS).cast("double"),
        "name_after": F.col("after").rlike(NEAR_NAMES).cast("double"),
    }).drop("covered")


def dictionary(docs: DataFrame, found: DataFrame, min_docs: int = MIN_WORD_DOCS) -> DataFrame:
    """Letter runs of the proposals that are words of the corpus: they occur
    in at least ``min_docs`` documents as words of their own."""
    runs = found.select(F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).filter(F.length("word").between(3, 24)).distinct()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).filter(
        F.length("word").between(3, 24))
    known = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    return known.join(runs, "word", "left_semi").select("word")


def seed_findings(spark: SparkSession) -> DataFrame:
    """Labelled findings (text, label, finding), ``SEEDS_PER_SHAPE`` of each shape: values of known shapes in the
    contexts in which they are, or are not, secrets."""
    h40, h64, h32 = F.sha1(F.col("id").cast("string").cast("binary")), F.sha2(F.col("id").cast("string"), 256), F.md5(F.col("id").cast("string").cast("binary"))
    b64 = F.translate(F.base64(F.unhex(h40)), "=", "")
    base32 = F.substring(F.translate(F.upper(F.concat(b64, h32)), "+/018", "ABCDE"), 1, 16)
    short = F.substring(h40, 1, 18)
    number = F.col("id") * 7919 + 104729
    uuid = F.concat_ws("-", F.substring(h32, 1, 8), F.substring(h32, 9, 4), F.substring(h32, 13, 4), F.substring(h32, 17, 4), F.substring(h32, 21, 12))
    aws, mixed = F.concat(F.lit("AKIA"), base32), F.substring(F.regexp_replace(F.concat(b64, F.base64(F.unhex(h64))), "[+/=]", "x"), 3, 24)
    web = F.concat_ws(".", F.lit("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"), F.translate(F.base64(F.concat(F.lit('{"sub":"'), number, F.lit('"}')).cast("binary")), "+/=", "-_"),
                      F.translate(F.base64(F.unhex(h64)), "+/=", "-_"))
    team = F.substring(F.upper(h40), 1, 9)
    hook = F.concat(F.lit("https://hooks.slack.com/services/T"), team, F.lit("/B"), team, F.lit("/"), mixed)
    title = F.concat(F.lit("the-long-title-of-it-"), F.col("id"))
    known = [
        (1, F.concat(F.lit("and the password="), short, F.lit(" was there"))), (1, F.concat(F.lit("token = \""), h40, F.lit("\" is for it"))),
        (1, F.concat(F.lit("over AKIA"), base32, F.lit(" then on"))), (1, F.concat(F.lit("use ghp_"), F.substring(F.concat(b64, h32), 1, 36))),
        (1, F.concat(F.lit("api_key: sk_live_"), F.substring(h64, 1, 24))), (1, F.concat(F.lit("secret='"), b64, F.lit("' "))),
        (1, F.concat(F.lit("AWS_SECRET_ACCESS_KEY="), F.substring(F.concat(b64, b64), 1, 40))), (1, F.concat(F.lit("xoxb-"), number, F.lit("-"), F.substring(h64, 1, 24))),
        (1, F.concat(F.lit("passwd: "), F.substring(b64, 1, 12), F.lit("9!"))), (1, F.concat(F.lit("the line AKIA"), base32)),
        (0, F.concat(F.lit("commit "), h40, F.lit(" merged"))), (0, F.concat(F.lit("sha256 checksum "), h64)),
        (0, F.concat(F.lit("request uuid "), uuid, F.lit(" done"))), (0, F.concat(F.lit("see https://host.example/path/"), h32, F.lit("/page"))),
        (0, F.concat(F.lit("image IMG_20240112_"), F.lpad(number.cast("string"), 9, "0"), F.lit("_final"))),
        (0, F.concat(F.lit("the path usr/share/doc/package"), F.col("id"), F.lit("/readme"))),
        (0, F.concat(F.lit("went to "), F.substring(F.concat(number, number, number, number), 1, 16), F.lit(" then on"))),
        (0, F.concat(F.lit("with "), F.substring(F.translate(h64, "abcdef", "357916"), 1, 19), F.lit(" of it"))),
        (0, F.concat(F.lit("card "), F.substring(F.translate(h64, "abcdef", "482054"), 2, 16), F.lit(" and more"))),
        (0, F.concat(F.lit("order number "), F.lpad(number.cast("string"), 20, "4"))), (0, F.concat(F.lit("words nationthereoning"), F.col("id"), F.lit("andthe of it"))),
        (0, F.concat(F.lit("build version-release-candidate-"), F.col("id"))), (0, F.concat(F.lit("token = \"example_placeholder_"), F.col("id"), F.lit("\""))),
        (1, F.concat(F.lit("AWS_ACCESS_KEY_ID="), aws)), (1, F.concat(F.lit("key="), aws, F.lit(" then"))), (1, F.concat(F.lit("SECRET_KEY="), h64)),
        (1, F.concat(F.lit("GITHUB=ghp_"), F.substring(F.concat(b64, h32), 1, 36))), (1, F.concat(F.lit("see https://host.example/?key="), aws, F.lit("&x=1"))),
        (1, F.concat(F.lit("at https://host.example/v1/"), aws, F.lit("/list")), aws), (1, F.concat(F.lit("post to "), hook), mixed),
        (1, F.concat(F.lit("with this."), aws)), (1, F.concat(F.lit("password1="), short)), (1, F.concat(F.lit("my_github_enterprise_access_token="), h40)),
        (1, F.concat(F.lit("send "), web, F.lit(" on"))), (1, F.concat(F.lit("at https://host.example/?jwt="), web)),
        (0, F.concat(F.lit("post to "), hook)), (0, F.concat(F.lit("at https://host.example/v1/user/"), aws, F.lit("/list"))), (0, F.concat(F.lit("commit="), h40)), (0, F.concat(F.lit("sha256:"), h64)), (0, F.concat(F.lit("id="), uuid)),
        (0, F.concat(F.lit("see https://host.example/?id="), h32, F.lit("&page=2"))), (0, F.concat(F.lit("see https://host.example/?request="), uuid)),
        (0, F.concat(F.lit("see https://host.example/path/"), h32, F.lit("/page")), h32), (0, F.concat(F.lit("see https://host.example/path/"), uuid), uuid),
        (0, F.concat(F.lit("see https://host.example/2024/01/"), title)), (0, F.concat(F.lit("see https://host.example/2024/01/"), title), title),
        (0, F.concat(F.lit("time=20240112101530"), number)), (0, F.concat(F.lit("the org.example.package-release-candidate-"), F.col("id"))),
        (0, F.concat(F.lit("see https://host.example/?order="), F.lpad(number.cast("string"), 20, "4"))),
        (0, F.concat(F.lit("token_1 = \"example_placeholder_"), F.col("id"), F.lit("\""))),
    ]
    which = F.col("id") % len(known)
    pick = lambda f: F.coalesce(*[F.when(which == k, f(v)) for k, v in enumerate(known)])
    return spark.range(SEEDS_PER_SHAPE * len(known)).select(
        pick(lambda v: v[1]).alias("text"), pick(lambda v: F.lit(v[0])).cast("double").alias("label"),
        pick(lambda v: v[2] if len(v) > 2 else F.lit(None).cast("string")).alias("finding"))


def train(findings: DataFrame, words: DataFrame) -> RandomForestClassificationModel:
    """Fit the forest on labelled findings (text, label, finding): bounded by what was labelled by hand or by ``seed_findings``."""
    rows = _proposals(findings.withColumn("proposal", F.monotonically_increasing_id()))
    order = F.struct(~F.coalesce(F.col("value") == F.col("finding"), F.lit(False)), "start", -F.col("end"))
    first = rows.groupBy("proposal").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "proposal"]), order).alias("r")).select("proposal", "r.*")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_features(first, words))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    fitted = forest.fit(written(data.select("label", "features"), "labelled-findings"))
    # A fitted model keeps its training summary and with it the session, which
    # tasks can't always be sent; a loaded one holds the trees alone.
    path = shared_path(findings.sparkSession, "forest")
    fitted.write().save(path)
    return RandomForestClassificationModel.load(path)


def _outermost(kept: DataFrame) -> DataFrame:
    """The proposals that lie in no other kept one of their row. They nest, so
    one that starts before the end of an earlier one lies in it."""
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("_reach", F.max("end").over(before)).filter(
        F.col("_reach").isNull() | (F.col("_reach") <= F.col("start")))


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per secret: doc_id, start, end, value, assigned, probability."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = written(_proposals(rows.withColumn("row", F.monotonically_increasing_id()))
                    .withColumn("proposal", F.monotonically_increasing_id()), "proposals")
    findings = seed_findings(spark)
    if labelled is not None:
        findings = findings.unionByName(labelled.select(
            "text", F.col("label").cast("double").alias("label"),
            (F.col("finding") if "finding" in labelled.columns else F.lit(None).cast("string")).alias("finding")))
    seeds = _proposals(findings).select("value")
    words = written(dictionary(rows, found.select("value").union(seeds)), "dictionary")
    model = train(findings, words)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_features(found, words))
    scored = model.transform(data).withColumn("probability", F.round(vector_to_array("probability")[1], 9))
    return _outermost(scored.filter(F.col("probability") >= threshold)).select(
        "doc_id", "start", "end", "value", (F.col("assigned") > 0).alias("assigned"), "probability")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with each of the sorted, disjoint ``spans`` replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text).cast("bigint"))))


def redact_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents with secrets replaced; all rows and columns stay, and
    ``n_chars`` (if there) is the new length of changed texts. Findings are
    kept by text digest, so repeated ids with other texts aren't mixed up."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    marked = docs.select(key.alias("doc_id"), "text")
    spans = find_secrets(marked, labelled).select(F.col("doc_id").alias("_digest"), "start", "end").distinct()
    per_text = spans.groupBy("_digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = docs.withColumn("_digest", key).join(per_text, "_digest", "left")
    text = F.when(F.col("_spans").isNotNull(), redact(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    out = joined.withColumn("_text", text)
    cols = [F.col("_text").alias("text") if c == "text"
            else F.when(F.col("_spans").isNotNull(), F.length("_text").cast(t)).otherwise(F.col(c)).alias(c) if c == "n_chars"
            else F.col(f"`{c}`") for c, t in docs.dtypes]
    return out.select(*cols)
