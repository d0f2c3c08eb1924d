"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates are found over whole texts, with their character offsets, at any length; the
value of an assignment ends at white space or a quote, a private key at its end line. The forest sees a
candidate's length, its changes between character classes, its entropy, how much of it
dictionary words cover, whether it looks like a path, and the words around it. It learns
from labelled findings; without a table of them, from findings made by rule (known key
formats against hashes, identifiers, placeholders, paths and numbers).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alternatives, tried in this order at each place: known key formats, assignments, long runs.
KEY = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s,:-]*?-----END [A-Z ]*PRIVATE KEY-----)?|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43,}"
ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?[ \t]*[:=][ \t]*[\"']?[^\s\"']{6,}+"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
CANDIDATE = f"{KEY}|{ASSIGNED}|{LONG}"
#: Every candidate holds one of these, in lower case, or a run of 20 characters of keys; looked for first, as it is much cheaper.
HINTS = ("passw", "pwd", "secret", "token", "api", "access", "auth", "xox", "private key", "eyj")
RUN = r"[A-Za-z0-9+/_=-]{20}"
#: Ordinary words in identifiers, placeholders and paths.
DICTIONARY = "example test sample demo dummy password passwd secret token changeme change your here none null true false user name admin root file path image data index page home lib usr bin var local src main version license public private key http https www com org net html json value default string config setting service server client request response message".split()
SECRET_WORDS = r"(?i)(password|passwd|pwd|secret|token|key|credential|auth|login)"
PUBLIC_WORDS = r"(?i)(commit|sha1?|sha256|md5|checksum|digest|uuid|guid|hash|revision|etag|fingerprint|example|sample|license|isbn|order|invoice)"
FEATURES = ["size", "digits", "uppers", "lowers", "others", "changes", "entropy", "covered", "slashes", "known", "assigned", "secret_before", "public_before", "public_after", "hex"]


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, candidate, value, before, after: every match, its secret part and 40 characters of either side."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower("t")
    hinted = F.col("t").rlike(RUN)
    for h in HINTS:
        hinted = hinted | F.contains(low, F.lit(h))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).where(hinted).where(F.col("t").rlike(CANDIDATE))
    both = rows.select("doc_id", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split("t", CANDIDATE, -1).alias("g"))
    # gap i comes before match i; offsets are the lengths of all gaps and matches before
    spans = F.expr("transform(m, (x, i) -> struct(i as i, x as candidate, right(g[i], 40) as before, left(g[i + 1], 40) as after, length(g[i]) as gap, length(x) as size))")
    starts = F.expr("transform(s, (x, i) -> struct(x.candidate as candidate, x.before as before, x.after as after, x.gap + aggregate(slice(s, 1, i), 0, (a, y) -> a + y.gap + y.size) as start))")
    one = both.select("doc_id", spans.alias("s")).select("doc_id", F.explode(starts).alias("s")).select("doc_id", "s.*")
    value = F.regexp_replace("candidate", r"^(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?[ \t]*[:=][ \t]*[\"']?", "")
    return one.withColumn("value", value)


def described(found: DataFrame) -> DataFrame:
    """Adds FEATURES, from candidate, value, before and after."""
    v = F.col("value")
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / size
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"[^A-Za-z0-9]", "-"), r"[0-9]", "0"), r"[A-Z]", "A"), r"[a-z]", "a")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    chars = F.filter(F.split(v, ""), lambda x: x != "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / size * F.log2((F.length(v) - F.length(F.replace(v, c, F.lit("")))) / size))
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    covered = 1 - F.length(F.regexp_replace(v, f"(?i)({words})", "")) / size
    flag = lambda c: c.cast("double")
    return found.withColumns({
        "size": size, "digits": share(r"[^0-9]"), "uppers": share(r"[^A-Z]"), "lowers": share(r"[^a-z]"), "others": share(r"[A-Za-z0-9]"),
        "changes": (runs - 1) / size, "entropy": F.coalesce(entropy, F.lit(0.0)), "covered": covered,
        "slashes": flag(F.length(F.regexp_replace(v, r"[^/.]", "")) + F.col("before").rlike(r"[/\\]$").cast("int")),
        "known": flag(F.col("candidate").rlike(f"^(?:{KEY})")), "assigned": flag(F.length(v) < F.length("candidate")),
        "secret_before": flag(F.concat(F.right("before", F.lit(24)), F.expr("left(candidate, length(candidate) - length(value))")).rlike(SECRET_WORDS)),
        "public_before": flag(F.col("before").rlike(PUBLIC_WORDS)), "public_after": flag(F.col("after").rlike(PUBLIC_WORDS)), "hex": flag(v.rlike(r"^[0-9a-fA-F-]+$")),
    })


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n findings made by rule: candidate, value, before, after, label. Half are secrets."""
    i = F.col("id")
    text = lambda salt, k: F.substring(F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 256), 1, k)
    base = lambda salt, k: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 256))), "+/=", "xyz"), 1, k)
    upper = F.upper(F.translate(base("u", 16), "01", "AB"))
    word = lambda salt, k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    size = F.pmod(F.xxhash64(i, F.lit("size")), F.lit(24)).cast("int")
    name = F.element_at(F.array(*map(F.lit, ["password", "secret", "token", "api_key", "passwd", "pwd"])), (F.pmod(F.xxhash64(i, F.lit("name")), F.lit(6)) + 1).cast("int"))
    glue = F.element_at(F.array(*map(F.lit, ["=", ": ", ' = "'])), (F.pmod(F.xxhash64(i, F.lit("glue")), F.lit(3)) + 1).cast("int"))
    plain = F.element_at(F.array(*map(F.lit, ["in the of and ", "was found near ", "les ou en ", "ver der ung "])), (F.pmod(F.xxhash64(i, F.lit("plain")), F.lit(4)) + 1).cast("int"))
    named = F.element_at(F.array(*map(F.lit, ["commit ", "md5 checksum ", "sha256 digest ", "uuid ", "revision hash "])), (F.pmod(F.xxhash64(i, F.lit("named")), F.lit(5)) + 1).cast("int"))
    kind = F.pmod(i, F.lit(16))
    none = F.lit("")
    # (assigned name, value, before); the first eight kinds are secrets
    rows = [
        (none, F.concat(F.lit("AKIA"), upper), plain), (F.concat(name, glue), text("a", 18), plain), (F.concat(name, glue), text("b", 40), plain), (F.concat(name, glue), F.expr("substring(sha2(cast(concat('c', id) as binary), 256), 1, 12 + cast(pmod(xxhash64(id, 'size'), 24) as int))"), plain),
        (none, F.concat(F.lit("ghp_"), base("g", 36)), plain), (F.concat(name, glue), base("d", 32), plain), (none, base("e", 40), F.concat(plain, name, F.lit(" "))), (F.concat(name, glue), F.concat(base("f", 10), F.lit("!"), text("h", 4)), plain),
        (none, text("i", 40), F.concat(plain, named)), (none, F.regexp_replace(text("j", 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(plain, named)), (F.concat(name, glue), F.concat(word("k", 1), F.lit("_"), word("l", 1), F.lit("_"), word("m", 1)), plain), (F.concat(name, glue), F.concat(F.lit("<your_"), word("n", 1), F.lit("_here>")), plain),
        (none, F.concat(F.lit("/"), word("o", 1), F.lit("/"), word("p", 1), F.lit("/"), word("q", 1), F.lit("/"), word("r", 1), F.lit("/"), word("s", 1)), plain), (none, F.concat(word("t", 1), F.initcap(word("u", 1)), F.initcap(word("v", 1)), F.initcap(word("w", 1)), F.initcap(word("x", 1))), plain), (none, F.repeat(F.lit("-="), 12), plain), (none, F.concat(F.translate(text("y", 20), "abcdef", "123456"), F.lit("0000")), F.concat(plain, F.lit("order "))),
    ]
    pick = lambda j: F.coalesce(*[F.when(kind == k, r[j]) for k, r in enumerate(rows)])
    made = spark.range(n).select("id", pick(0).alias("head"), pick(1).alias("value"), pick(2).alias("before"), (kind < 8).cast("double").alias("label"))
    return made.select(F.concat("head", "value").alias("candidate"), "value", F.right("before", F.lit(40)).alias("before"), F.lit(" and the").alias("after"), "label")


def train(labelled: DataFrame, trees: int = 40, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(labelled)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per finding: doc_id, start, length (characters), kind, candidate, score, is_secret.

    ``labelled`` has candidate, value, before, after and label (1.0 for a secret). Null and
    empty texts have no findings. Repeated rows have theirs each; null ids stay null; other
    columns are ignored. Findings of a text do not overlap; the leftmost wins, then the order
    of the patterns.
    """
    spark = docs.sparkSession
    model = train(labelled if labelled is not None else labelled_findings(spark))
    found = described(candidates(docs, id_col, text_col))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    kind = F.when(F.col("known") == 1, "key").when(F.col("assigned") == 1, "assignment").otherwise("long")
    out = scored.withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return out.select("doc_id", "start", F.length("candidate").alias("length"), kind.alias("kind"), "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
