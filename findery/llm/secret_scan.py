"""Secret scan with a random forest that removes false positives (operator 7), in DataFrame functions throughout.

Candidates are known key formats and values assigned to secret-like names. Features of each: length, character classes
and transitions between them, variety, dictionary coverage, path-like parts and the words around it. The forest is
trained by Spark ML on labelled findings: the caller's, or generated ones of the usual true and false kinds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.llm.common import fits_broadcast, reading, saved

NAMES = r"(?i:(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)[a-z0-9_-]{0,20})"
#: Public key formats.
FORMATS = {
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[0-9A-Za-z]{36,}+",
    "slack": r"\bxox[abprs]-[0-9A-Za-z-]{10,}+",
    "stripe": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+",
    "google": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[0-9A-Za-z+/=\s\\]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?",
}
#: Values of any length: possessive classes neither backtrack nor recurse. A PEM key holds spaces, so it is named here too.
ASSIGNED = NAMES + r"[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}[\"']?(?:" + FORMATS["pem"] + r"|[^\s\"'<>,;]{8,}+)"
CANDIDATE = "|".join([*FORMATS.values(), ASSIGNED])
HEAD = "^" + NAMES + r"[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}[\"']?"
#: Words that speak for a placeholder or code, and frequent letter pairs of prose.
WORDS = "access|admin|api|auth|change|client|config|default|demo|dummy|env|example|fake|function|get|here|hidden|insert|key|login|me|my|none|null|page|param|pass|password|path|placeholder|private|process|public|redacted|replace|request|reset|root|sample|secret|self|service|session|string|template|test|this|token|true|user|value|welcome|your|xxx+|123456789|12345|abcdef|\\*\\*+"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
FEATURES = ["n", "digits", "uppers", "lowers", "marks", "to_digit", "from_digit", "case_change", "distinct", "longest_letters", "hex", "words", "pairs", "path_like", "call_like", "named", "shaped", "doubt_before", "doubt_after", "quoted"]
MASK = "[secret]"
THRESHOLD = 0.5
TREES, DEPTH, SEED = 30, 8, 7
SAMPLE = 50_000


def share(pattern: str, of: Column) -> Column:
    return (F.length(of) - F.length(F.regexp_replace(of, pattern, ""))) / F.greatest(F.length(of), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of (match, before, after); nulls count as empty."""
    match, before, after = (F.coalesce(F.col(c), F.lit("")) for c in ("match", "before", "after"))
    v = F.regexp_replace(match, HEAD, "")
    low = F.lower(v)
    letters = F.transform(F.split(v, "[^A-Za-z]+"), F.length)
    doubt = "(?i)example|sample|dummy|placeholder|fake|template|test|docs?\\b|demo|mock"
    columns = {
        "n": F.length(v), "digits": share("[0-9]", v), "uppers": share("[A-Z]", v), "lowers": share("[a-z]", v), "marks": share("[^A-Za-z0-9]", v),
        "to_digit": F.regexp_count(v, F.lit("(?<=[A-Za-z])[0-9]")) / F.greatest(F.length(v), F.lit(1)), "from_digit": F.regexp_count(v, F.lit("(?<=[0-9])[A-Za-z]")) / F.greatest(F.length(v), F.lit(1)),
        "case_change": F.regexp_count(v, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / F.greatest(F.length(v), F.lit(1)), "distinct": F.size(F.array_distinct(F.split(v, ""))), "longest_letters": F.array_max(letters),
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("int"), "words": share(WORDS, low), "pairs": share(PAIRS, low), "path_like": F.regexp_count(v, F.lit("[/\\\\]|\\.[a-z]{2,4}\\b")), "call_like": F.regexp_count(v, F.lit("[(){}\\[\\]$<>]|\\b[a-z]+\\.[a-z]+")),
        "named": match.rlike("(?s)" + HEAD).cast("int"), "shaped": match.rlike("^(?s:" + "|".join(FORMATS.values()) + ")").cast("int"), "doubt_before": F.substring(before, -40, 40).rlike(doubt).cast("int"), "doubt_after": F.substring(after, 1, 40).rlike(doubt).cast("int"), "quoted": F.substring(after, 1, 1).isin("\"", "'").cast("int"),
    }
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def generated_findings(spark: SparkSession, each: int = 250) -> DataFrame:
    """Labelled findings (match, before, after, label): random values as keys, and placeholders, code, paths and prose as false ones."""
    i = F.col("id").cast("string")
    pick = lambda salt, *of: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    b64 = F.base64(F.unhex(F.sha2(F.concat(i, F.lit("b")), 256)))
    alnum = F.regexp_replace(F.concat(b64, F.base64(F.unhex(F.sha2(i, 256)))), "[^A-Za-z0-9]", "")
    name = pick("name", "token", "TOKEN", "api_key", "apiKey", "secret", "client_secret", "password", "db_password", "AWS_SECRET_ACCESS_KEY", "access_token")
    sign = pick("sign", " = \"", "=\"", ": \"", "=", " = ", ": '", "='")
    word = lambda salt: pick(salt, "river", "thinking", "erantion", "station", "other", "heating", "under", "nation", "letter", "therein", "mountain", "reader", "handle", "ation")
    true = [F.sha1(i), F.upper(F.sha1(i)), F.md5(i), F.sha2(i, 256), b64, F.substring(alnum, 1, 20), F.substring(alnum, 3, 32), F.substring(b64, 1, 14)]
    true = [F.concat(name, sign, x) for x in true] + [F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 5, 16))), F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(alnum, 1, 24)), F.concat(F.lit("AIza"), F.substring(alnum, 1, 35)), F.concat(F.lit("xoxb-"), F.substring(F.sha1(i), 1, 12), F.lit("-"), F.substring(alnum, 1, 24))]
    false = [
        pick("f1", "your_api_key_here", "your-token-here", "changeme123", "xxxxxxxxxxxxxxxx", "password123", "********", "placeholder", "REPLACE_ME_WITH_TOKEN", "<redacted>", "insert_key_here", "example_secret_value", "1234567890", "abcdefgh12345678", "default_password"),
        pick("f2", "${SECRET_TOKEN}", "process.env.API_KEY", "os.environ[KEY]", "config.get(token)", "getPassword(user)", "request.headers.token", "self.secret_value", "{{password}}", "$(cat-secret)", "function(x){return"),
        F.concat(F.lit("/etc/"), word("p1"), F.lit("/"), word("p2"), F.lit(".pem")), F.concat(F.lit("https://"), word("u1"), F.lit(".example.com/"), word("u2")),
        F.concat(word("w1"), word("w2")), F.concat(word("w3"), F.lit("-"), word("w4"), F.lit("_"), word("w5")), F.concat(F.initcap(word("w6")), F.initcap(word("w7"))), F.repeat(pick("r", "a", "0", "x", "*", "-", "."), 16), F.concat(word("v"), F.lit("."), F.pmod("id", F.lit(9)).cast("string")),
    ]
    false = [F.concat(name, sign, x) for x in false] + [F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 9)), F.lit("EXAMPLE")), F.concat(F.lit("sk_test_"), F.repeat(F.lit("x"), 24))]
    context = pick("before", "the code sets ", "deploy with ", "config: ", "and then ", "")
    doubtful = pick("doubt", "for example ", "a sample, ", "in this test ", "dummy value ", "template: ")
    every, n_true = [*true, *false], len(true)
    rows = spark.range(0, each * len(every), 1, 4).select(F.expr(f"id div {len(every)}").alias("id"), (F.col("id") % len(every)).cast("int").alias("kind"))
    rows = rows.withColumn("match", F.get(F.array(*every), F.col("kind")))
    plain = (F.col("kind") < n_true) | (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    return rows.select("match", F.when(plain, context).otherwise(doubtful).alias("before"), F.when(F.col("match").contains("\""), "\" and").otherwise(" and").alias("after"), F.when(F.col("kind") < n_true, 1.0).otherwise(0.0).alias("label"))


def train_forest(findings: DataFrame, sample: int = SAMPLE) -> PipelineModel:
    """A forest from labelled findings (match, before, after, label 0 or 1): at most `sample` of them, those of the smallest hashes."""
    rows = with_features(saved(findings.filter("label is not null"))).orderBy(F.xxhash64("match", "before"), "match", "before", "after", "label").limit(sample).select(*FEATURES, "label")
    rows = saved(rows)  # the forest reads them several times
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(assembler.transform(rows))
    return PipelineModel([assembler, forest])


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: the document's columns without text, __row, k, the text before it (gap), match, after (the next gap), last."""
    hits = docs.filter(F.col("text").rlike(CANDIDATE)).withColumn("__row", F.monotonically_increasing_id())
    hits = hits.withColumns({"__match": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), "__gap": F.split("text", CANDIDATE, -1)}).drop("text")
    hits = hits.select("*", F.posexplode("__match").alias("k", "match"))
    return hits.withColumns({"before": F.get("__gap", F.col("k")), "after": F.get("__gap", F.col("k") + 1), "last": F.col("k") + 1 == F.size("__match")}).drop("__match", "__gap")


def judged(docs: DataFrame, findings: DataFrame | None, threshold: float) -> DataFrame:
    model = train_forest(findings if findings is not None else generated_findings(docs.sparkSession))
    out = model.transform(with_features(candidates(docs))).withColumn("probability", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("probability") >= threshold).drop(*FEATURES, "features", "rawPrediction", "prediction")


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate of every whole text (doc_id, text): doc_id, start and length of the value in characters from 0, kind, value, probability, is_secret.

    Null and empty texts have none; repeated rows repeat theirs; other columns are ignored. An empty table gives no rows.
    """
    at = Window.partitionBy("__row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = judged(docs.select("doc_id", "text"), findings, threshold)
    passed = F.coalesce(F.sum(F.length("before") + F.length("match")).over(at), F.lit(0)) + F.length("before")
    value = F.regexp_replace("match", HEAD, "")
    kind = reduce(lambda k, f: k.when(value.rlike("^(?s:" + f[1] + ")"), f[0]), FORMATS.items(), F).otherwise("assigned")
    found = found.withColumn("end", passed + F.length("match"))
    return found.select("doc_id", (F.col("end") - F.length(value)).cast("long").alias("start"), F.length(value).cast("long").alias("length"), kind.alias("kind"), value.alias("value"), "probability", "is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """All rows and columns of docs, with each secret's value in `text` replaced by the mask. Nulls stay; texts without secrets stay as they are.

    Texts with candidates are rewritten and saved. The others are those whose 128-bit hash isn't among theirs; only where
    these hashes are too many to broadcast, all texts are searched a second time. An empty table stays empty.
    """
    names = [c for c in docs.columns if c != "text"]
    own = {c: f"__c{i}" for i, c in enumerate(names)}
    hashes = {"__h0": F.xxhash64("text"), "__h1": F.xxhash64(F.lit("text"), "text")}
    renamed = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in own.items()), "text", *(c.alias(a) for a, c in hashes.items()))
    found = judged(renamed, findings, threshold)
    value = F.regexp_replace("match", HEAD, "")
    put = F.when(F.col("is_secret"), F.concat(F.expr("left(match, length(match) - length(__value))"), F.lit(mask))).otherwise(F.col("match"))
    part = F.concat("before", put, F.when(F.col("last"), F.col("after")).otherwise(""))
    rebuilt = found.withColumn("__value", value).withColumn("__part", part).groupBy("__row").agg(*(F.first(a).alias(a) for a in (*own.values(), *hashes)), F.sort_array(F.collect_list(F.struct("k", "__part"))).alias("__parts"))
    rebuilt = saved(rebuilt.withColumn("text", F.array_join(F.transform("__parts", lambda p: p["__part"]), "")).drop("__parts", "__row"))
    keys = saved(rebuilt.select(*hashes).distinct())
    if fits_broadcast(keys, 48):
        clean = renamed.join(F.broadcast(keys), [*hashes], "left_anti")
    else:
        clean = renamed.filter(F.col("text").isNull() | ~F.col("text").rlike(CANDIDATE))
    columns = [F.col(own.get(c, c)).alias(c) for c in docs.columns]
    return reading(clean.select(*columns).unionByName(rebuilt.select(*columns)), rebuilt, keys)
