"""Secret scans with a random forest that removes false positives (DataFrame functions only).

Candidates are long strings of key characters, and values of any length that a naming word is assigned. A
forest, trained from labelled findings, scores each by its digits and length, its character transitions, how much of it the corpus's own
words cover, the path it stands at, and the words beside it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import col, few, materialise, table, top

BESIDE = 48
#: Words that stand beside real findings, beside harmless ones, and in paths of samples.
NEAR = ("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "integrity", "rev", "revision", "version", "id", "phone",
            "card", "iban", "order", "invoice", "isbn", "serial", "href", "src", "url", "file")
_SCHEME = r"(?i:bearer|basic|token)[ \t]"
_TO = rf"[:=]{{1,3}}>?[ \t]{{0,4}}(?:{_SCHEME}{{1,2}})?"
_NAME = rf"(?i:{'|'.join(NEAR)})(?:[0-9_.\-][A-Za-z0-9_.\-]{{0,24}})?[\"'`]?[ \t]{{0,4}}"
#: What a naming word is assigned, to the closing quote or the end of the value; else 16 or more key characters, where
#: "=" only pads the end, so that a name and its "=" are no part of the value.
CANDIDATE = (rf"(?<=[\"'])(?<=[:=]>?[ \t]{{0,4}}[\"'])(?:(?<={_NAME}{_TO}\")[^\"\r\n]++(?=\")|(?<={_NAME}{_TO}')[^'\r\n]++(?='))"
             rf"|(?<=[:=> \t\"'`])(?<={_TO}[\"'`]?)(?<={_NAME}{_TO}[\"'`]?)(?!{_SCHEME})[^\s\"'`<>,;&(){{}}\[\]:=][^\s\"'`<>,;&(){{}}\[\]]*+"
             r"|[A-Za-z0-9+/_.\-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=.\-]))?+")
SAMPLES = ("test", "tests", "example", "examples", "sample", "fixture", "fixtures", "doc", "docs", "mock", "demo", "spec", "vendor", "lock")
FEATURES = ("length", "changes", "upper_share", "lower_share", "digit_share", "other_share", "distinct_share", "hex", "digits_only", "covered", "near", "harmless",
            "digit", "names", "assigned", "quoted", "depth", "sample_path", "dots", "dashes", "slashes")


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, path, nth, start, end, cand, before, after): every candidate with its character offsets (from 0) and neighbours,
    which may hold the candidate before it."""
    path = col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(col(id_col).alias("id"), path.alias("path"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    found = rows.withColumn("cands", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))).where(F.size("cands") > 0)
    # the gaps between candidates, in order: one more than there are candidates
    cut = found.withColumn("gaps", F.split("t", CANDIDATE, -1)).drop("t")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.expr("cast(array() as array<struct<start:int,before:string>>)").alias("found"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(BESIDE))
        return F.struct((start + F.length(x["cand"])).alias("at"), F.right(F.concat(before, x["cand"]), F.lit(BESIDE)).alias("tail"),
                        F.array_append(acc["found"], F.struct(start.alias("start"), before.alias("before"))).alias("found"))

    pairs = F.zip_with("cands", F.slice("gaps", 1, F.size("cands")), lambda c, g: F.struct(c.alias("cand"), g.alias("gap")))
    each = cut.withColumn("found", F.aggregate(pairs, zero, add, lambda acc: acc["found"])).select(
        "id", "path", F.explode(F.transform("cands", lambda c, i: F.struct(
            i.alias("nth"), F.col("found")[i]["start"].alias("start"), c.alias("cand"),
            F.col("found")[i]["before"].alias("before"), F.left(F.col("gaps")[i + 1], F.lit(BESIDE)).alias("after")))).alias("x"))
    return each.select("id", "path", "x.nth", "x.start", (F.col("x.start") + F.length("x.cand")).alias("end"), "x.cand", "x.before", "x.after")


def dictionary(docs: DataFrame, text_col: str, size: int = 1500, min_share: float = 0.001) -> list[str]:
    """The ``size`` words of 3 to 12 letters that stand in most documents, and in ``min_share`` of them, counted over
    all documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(col(text_col).cast("string")), F.lit(r"\b[\p{L}]{3,12}\b"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") >= max(1.0, min_share * docs.count()))
    return [r["w"] for r in top(often, size, F.desc("n"), "w")]


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}]+[0-9]*"), F.lit(0))


def _share(c: Column, kind: str) -> Column:
    return 1 - F.length(F.regexp_replace(c, f"[{kind}]", "")) / F.length(c)


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds the forest's features to candidates (cand, before, after, path)."""
    c = F.col("cand")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9"), "[^Aa9]", "_")
    chunks = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    known = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    covered = F.aggregate(F.filter(chunks, lambda w: F.array_contains(known, w)), F.lit(0), lambda acc, w: acc + F.length(w))
    before, path = _words(F.col("before")), _words(F.col("path"))

    def any_of(found_words: Column, wanted: tuple[str, ...]) -> Column:
        return F.arrays_overlap(found_words, F.array(*[F.lit(w) for w in wanted])).cast("double")

    near = F.slice(F.reverse(before), 1, 3)
    return found.withColumns({
        "length": F.length(c).cast("double"),
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.length(c),
        "upper_share": _share(c, "A-Z"), "lower_share": _share(c, "a-z"), "digit_share": _share(c, "0-9"), "other_share": _share(c, "^A-Za-z0-9"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(40)),
        "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"), "digits_only": c.rlike("^[0-9.\\-]+$").cast("double"),
        "covered": covered / F.length(c), "near": any_of(near, NEAR), "harmless": any_of(near, HARMLESS),
        "digit": c.rlike("[0-9]").cast("double"), "names": F.col("after").rlike("^[\"'`]?[ \\t]*[=:]").cast("double"),
        "assigned": F.col("before").rlike("[=:]\\s*[\"'`]?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
        "depth": F.size(F.split(F.coalesce("path", F.lit("")), "/")).cast("double"), "sample_path": any_of(path, SAMPLES),
        "dots": (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))).cast("double"),
        "dashes": (F.length(c) - F.length(F.replace(c, F.lit("-"), F.lit("")))).cast("double"),
        "slashes": (F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))).cast("double")})


def train(findings: DataFrame, words: list[str], trees: int = 40, depth: int = 8, max_rows: int = 20_000) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (cand, before, after, path, label 0/1), at most ``max_rows`` of them by
    smallest digest (the documented bound). Findings with a null candidate or label are left out; without findings of
    both labels there is no forest (None)."""
    good = findings.where("cand IS NOT NULL AND label IS NOT NULL")
    rows = few(good, max_rows, good.count(), "cand", "before", "after")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        with_features(rows.withColumns({n: F.coalesce(n, F.lit("")) for n in ("before", "after")}), words))
    ready = materialise(ready.select("features", F.col("label").cast("double").alias("label")), "findings")
    if ready.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird", minInstancesPerNode=2)
    return forest.fit(ready)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None, words: list[str], id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, nth, start, end (character offsets), candidate, score, is_secret.

    Whole texts are scanned. Null and empty texts have no candidates; a null path is an empty one; repeated
    rows give repeated results; an empty table gives an empty result; other columns are not read. Without a
    forest (nothing to learn from) scores are null and no candidate is a secret.
    """
    if model is None:
        return candidates(docs, id_col, text_col, path_col).select(
            F.col("id").alias(id_col), "nth", "start", "end", F.col("cand").alias("candidate"), F.lit(None).cast("double").alias("score"),
            F.lit(False).alias("is_secret"))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs, id_col, text_col, path_col), words))
    scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "nth", "start", "end", F.col("cand").alias("candidate"), "score",
                         (F.col("score") >= threshold).alias("is_secret"))


# ---- labelled findings

def _from_digest(*key: str) -> tuple[Column, Column, Column]:
    """(hex, base64, number) of a row's digest."""
    d = F.sha2(F.concat_ws("/", *[F.lit(k) if k.startswith("=") else F.col(k).cast("string") for k in key]), 512)
    return d, F.base64(F.unhex(d)), F.conv(F.substring(d, 1, 12), 16, 10)


def findings_from(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, sampled: int = 1000) -> DataFrame:
    """Labelled findings in contexts of the corpus: for ``sampled`` documents (by smallest digest of the id), one string
    of every kind, made from the document's digest, beside words of the document.

    Real: keys and tokens after a naming word and an assignment, or of a known form. Harmless: digests of
    commits and files, ids, numbers of cards and orders, addresses, file names, long words, samples.
    """
    path = F.coalesce(col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(col(id_col).cast("string").alias("id"), path.alias("path"), col(text_col).cast("string").alias("t")) \
        .where("t IS NOT NULL AND id IS NOT NULL").select("id", "path", F.slice(F.split("t", r"\s+"), 1, 40).alias("ws"))
    every = rows.select("id").distinct()
    picked = materialise(few(every, sampled, every.count(), "id"), "picked")
    rows = rows.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct("path", "ws")).alias("r")).select("id", "r.*")
    h, b64, number = _from_digest("id", "=one")
    h2, b64_2, _ = _from_digest("id", "=two")
    word = F.coalesce(F.element_at("ws", (F.pmod(F.xxhash64("id"), F.size("ws")) + 1).cast("int")), F.lit("word"))
    three = F.array_join(F.transform(F.slice("ws", 1, 6), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", "")), "")
    plain = F.regexp_replace(b64, "[+/=]", "x")
    letters = F.translate(plain, "0123456789", "qWzRtYuIoP")
    lead = F.concat(word, F.lit(" "))

    def one(label: int, before: str, cand: Column, after: str = " ", where: Column | None = None) -> Column:
        return F.struct(F.lit(label).alias("label"), F.concat(lead, F.lit(before)).alias("before"), cand.alias("cand"),
                        F.concat(F.lit(after), word).alias("after"), (where if where is not None else F.col("path")).alias("path"))

    kinds = [
        one(1, 'token = "', F.substring(h, 1, 40), '" '), one(1, 'TOKEN = "', F.upper(F.substring(h2, 1, 40)), '"!! '),
        one(1, 'secret: "', F.substring(plain, 1, 32), '", '), one(1, "api_key=", F.substring(plain, 5, 24), "\n"), one(1, "password: ", F.substring(b64_2, 3, 20)),
        one(1, "Authorization: Bearer ", F.concat(F.substring(plain, 1, 20), F.lit("."), F.substring(b64_2, 1, 40))),
        one(1, "", F.concat(F.lit("AKIA"), F.upper(F.substring(h, 3, 16)))), one(1, "private key ", F.substring(b64, 1, 60)),
        one(1, "auth ", F.concat(F.lit("ghp_"), F.substring(plain, 2, 36))), one(1, 'access_key = "', F.substring(h, 1, 64), '"'),
        one(1, "API_KEY=", F.substring(letters, 3, 16), "\n"), one(1, "password=", F.substring(letters, 9, 20)), one(1, 'secret = "', F.substring(letters, 5, 32), '"'),
        one(1, "DB_PASSWORD=", F.substring(plain, 7, 9), "\n"), one(1, "password: ", F.concat(F.substring(letters, 11, 5), F.lit("!"), F.substring(number, 1, 3))),
        one(1, 'passwd: "', F.substring(plain, 30, 12), '"'), one(1, "AUTH_TOKEN=", F.substring(h2, 1, 32), "\n"), one(1, "pwd=", F.substring(letters, 20, 8)),
        one(0, "commit ", F.substring(h, 1, 40)), one(0, "md5 ", F.substring(h, 1, 32)), one(0, "sha256: ", F.substring(h, 1, 64)),
        one(0, 'integrity="', F.concat(F.lit("sha512-"), b64), '"'), one(0, "", F.lpad(number, 16, "4")), one(0, "card ", F.lpad(number, 16, "5")),
        one(0, "order = ", F.lpad(number, 18, "0")), one(0, 'id="', F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), '"'),
        one(0, "", F.concat(F.substring(three, 1, 18), F.lit("2"))), one(0, "", F.concat(F.substring(three, 1, 12), F.lit(".34"), F.lit("@mail7.example.com"))),
        one(0, "src=/", F.concat(F.lit("static/js/"), F.substring(three, 1, 8), F.lit("."), F.substring(h, 1, 8), F.lit(".min.js"))),
        one(0, "see ", F.concat_ws(".", *[F.conv(F.substring(h, i, 2), 16, 10) for i in (1, 3, 5, 7)], F.lit("example.com"))),
        one(0, "phone ", F.concat_ws("-", F.lit("001"), F.substring(number, 1, 4), F.substring(number, 5, 4), F.lit("0000"))),
        one(0, 'token = "', F.lit("xxxxxxxxxxxxxxxx1234"), '"'), one(0, "api_key=", F.lit("your-api-key-goes-here-1")), one(0, "password: ", F.lit("example-password-123")),
        one(0, "", F.substring(three, 1, 20)), one(0, "", F.upper(F.substring(three, 1, 18)), "!"), one(0, "see ", F.concat_ws("-", F.substring(three, 1, 9), F.substring(three, 4, 12))),
        one(0, "in ", F.concat(F.lit("src/main/"), F.substring(three, 1, 12), F.lit(".java"))), one(0, "", F.concat(F.substring(three, 1, 10), F.lit("_api_key_name")), "="),
        one(0, "key: ", F.lower(word)), one(0, "password: ", F.substring(three, 1, 9)), one(0, "token = ", F.lit("null")), one(0, "access: ", F.substring(three, 3, 7)),
        one(0, "key = ", F.substring(number, 1, 2)), one(0, "PASSWORD=", F.lit("changeme"), "\n"), one(0, "API_KEY=", F.lit("your_api_key"), "\n"),
        one(0, 'token = "', F.substring(h2, 1, 40), '" ', F.concat(F.lit("tests/fixtures/"), F.col("path"))),
        one(0, "version ", F.concat_ws(".", F.lit("10"), F.lit("2"), F.substring(number, 1, 6), F.lit("build"), F.substring(number, 7, 4))),
    ]
    made = rows.select(F.explode(F.array(*kinds)).alias("x")).select("x.*")
    # a finding is what the scan finds of the made string, with the neighbours it has in the scan
    made = made.select(F.struct("label", F.length("before").alias("at"), F.length("cand").alias("n")).alias("made"), F.concat("before", "cand", "after").alias("t"), "path")
    found = candidates(made, "made", "t", "path").where("start < id.at + id.n AND end > id.at")
    return found.select("id.label", "before", "cand", "after", "path")


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of ``documents``; its path is the document's source."""
    docs = table(spark, sf_dir, "documents")
    words = dictionary(docs, "text")
    model = train(findings_from(docs, "doc_id", "text", "source"), words)
    return scan(docs, model, words, path_col="source")

