"""URL filtering by stated rules and by mined association rules, in DataFrame functions only.

Stated rules (host, path prefix) come first: a rule fits its host and all subdomains
where the path starts with the rule's; the longest one wins. Other URLs are judged by
association rules "these URL tokens, so block", mined by FP-growth from the URLs labelled
block, pruned by support and confidence and of every rule that a shorter one covers, and
matched by an inverted index on each rule's rarest token.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microveil.llm.shared import cut, numbered

#: Words of host names that label a URL as to be blocked where no stated rule fits; a documented, replaceable seed.
SEED_TERMS = ("adult", "ads", "bets", "casino", "malware", "phishing", "pills", "porn", "spam", "warez")


def parsed(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z in lower case) and path to rows of ``url``. One without ``://`` has both empty."""
    rest = "if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')"
    cut_host = F.regexp_extract(F.expr(rest), r"^[^/?#]*", 0)
    out = urls.withColumns({"host": F.translate(cut_host, string.ascii_uppercase, string.ascii_lowercase), "path": F.regexp_extract(F.expr(rest), r"^[^/?#]*([^?#]*)", 1)})
    return out


def tokens(urls: DataFrame) -> DataFrame:
    """Adds ``tokens``: the host's labels and their words, the top-level domain, the first path part, the extension and query keys."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    words = F.flatten(F.transform(labels, lambda x: F.when(F.instr(x, "-") > 0, F.filter(F.split(x, "-"), lambda y: y != "")).otherwise(F.array().cast("array<string>"))))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), lambda x: x != "")
    named = lambda prefix, xs: F.transform(xs, lambda x: F.concat(F.lit(prefix), x))
    first = F.when(F.size(parts) > 1, F.array(F.element_at(parts, 1))).otherwise(F.array().cast("array<string>"))
    extension = F.filter(F.array(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)), lambda x: x != "")
    top = F.when(F.size(labels) > 0, F.array(F.element_at(labels, -1))).otherwise(F.array().cast("array<string>"))
    return urls.withColumn("tokens", F.array_distinct(F.concat(named("host:", labels), named("word:", words), named("top:", top), named("path:", first), named("ext:", extension), named("key:", keys))))


def stated(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host, path, rule and rule_verdict for the distinct (host, path) that a rule fits.

    ``rules`` are (verdict, "host/path prefix"). Of rules of equal length the one with the
    longer host wins, then the smaller one.
    """
    split = [(r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "", r, v) for v, r in rules]
    row = lambda r: F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("r_host", "r_path", "rule", "rule_verdict"), strict=True)])
    known = urls.sparkSession.range(1).select(F.inline(F.array(*map(row, split)))) if split else urls.sparkSession.range(0).selectExpr("'' AS r_host", "'' AS r_path", "'' AS rule", "'' AS rule_verdict")
    places = urls.select("host", "path").distinct().where("host <> ''")
    labels = F.split("host", r"\.")
    ends = places.withColumn("r_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fits = ends.join(known, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("r_host"), F.xxhash64("rule")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.*")


SALTS = 16


def salted(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which a key that many of ``rows`` have is dealt to ``SALTS`` tasks; ``small`` is repeated for each."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(SALTS)))
    every = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(every, [*keys, "_salt"], how).drop("_salt")


def mined_rules(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(tokens, n) of the rules and (token, class, n) of the tokens they are about; labelled has tokens and label (block or allow).

    A rule is a smallest set of tokens that ``support`` of the URLs labelled block (two at least) have and of which ``confidence`` of all labelled URLs
    that have it are labelled block. Tokens that occur in the same labelled URLs, as the query keys of a template do, are one class and stand
    for one another: rules name classes, each by its smallest token, and a class is met by any of its tokens. Single classes are judged
    by counting. FP-growth then runs over the blocked URLs alone and what is left of their classes; its sets, which are frequent among
    the blocked, are counted among all URLs by an inverted index.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.where("size(tokens) > 0 AND label IN ('block', 'allow')").groupBy(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "label").agg(F.count("*").alias("w")))
    bad = rows.agg(F.sum(F.when(F.col("label") == "block", F.col("w")))).first()[0] or 0
    none = spark.createDataFrame([], "tokens array<string>, n int"), spark.createDataFrame([], "token string, class string, n long")
    if bad < 2:  # no rule can have two
        return none
    least = max(support * bad, 2)
    each = rows.withColumn("id", F.monotonically_increasing_id()).select("id", "label", "w", F.explode("tokens").alias("token"))
    # where a token occurs, as two sums of hashes over the different rows
    place = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(38,0)"))
    block = F.coalesce(F.sum(F.when(F.col("label") == "block", F.col("w"))), F.lit(0))
    stats = each.groupBy("token").agg(F.sum("w").alias("n"), block.alias("n_block"), place(1).alias("s1"), place(2).alias("s2")).where(F.col("n_block") >= least)
    classes = cut(stats.withColumn("class", F.min("token").over(Window.partitionBy("n", "n_block", "s1", "s2"))).drop("s1", "s2"))
    sure = F.col("n_block") >= confidence * F.col("n")
    single = classes.where(sure & (F.col("token") == F.col("class"))).select(F.array("class").alias("tokens"), F.lit(1).alias("n"))
    rest = classes.where(~sure)
    in_class = each.join(rest.select("token", "class", F.col("n").alias("n_all")), "token")
    baskets = cut(in_class.groupBy("id", "label", "w").agg(F.collect_set("class").alias("items")))
    blocked = baskets.where("label = 'block' AND size(items) > 1")
    n_rows = blocked.agg(F.sum("w")).first()[0] or 0
    found = single
    if n_rows >= least:
        expanded = blocked.select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w")))).select("items")
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 1e-6) / n_rows), minConfidence=1.0).fit(expanded).freqItemsets.where("size(items) > 1")
        sets = cut(sets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_block")))
        rarity = rest.where("token = class").select(F.col("class").alias("k"), F.col("n").alias("n_all"))
        posted = sets.select("tokens", "n_block", F.explode("tokens").alias("k")).join(rarity, "k").groupBy("tokens", "n_block").agg(F.min_by("k", F.struct("n_all", "k")).alias("k"))
        allowed = baskets.where("label = 'allow'").select("id", "w", "items", F.explode("items").alias("k"))
        against = salted(allowed, posted, ["k"]).where("size(array_except(tokens, items)) = 0").groupBy("tokens").agg(F.sum("w").alias("n_allow"))
        both = sets.join(against, "tokens", "left").withColumn("n_allow", F.coalesce("n_allow", F.lit(0)))
        rules = cut(both.where(F.col("n_block") >= confidence * (F.col("n_block") + F.col("n_allow"))).select("tokens", F.size("tokens").alias("n")))
        # a rule of which a part is a rule too adds nothing: parts are looked up by each token of the longer rule
        less = rules.select(F.col("tokens").alias("t2"), F.col("n").alias("n2"), F.col("tokens")[0].alias("k"))
        parts = rules.select("tokens", "n", F.explode("tokens").alias("k")).join(less, "k")
        covered = parts.where("n2 < n AND size(array_except(t2, tokens)) = 0").select("tokens").distinct()
        found = single.unionByName(rules.join(covered, "tokens", "left_anti"))
    found = cut(found)
    used = found.select(F.explode("tokens").alias("class")).distinct()
    return found, classes.join(used, "class").select("token", "class", "n")


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """(tokens, n) of ``mined_rules``."""
    return mined_rules(labelled, support, confidence)[0]


def matched(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(url, mined): of the rules that a URL's tokens meet, the smallest as the URL's own tokens spell it. ``urls`` has distinct url and its tokens."""
    own = salted(urls.select("url", F.explode("tokens").alias("token")), classes, ["token"])
    met = own.groupBy("url").agg(F.collect_list(F.struct("class", "token", "n")).alias("t"))
    # of a class, the smallest token that the URL has; a URL's own tokens only
    ids = F.array_distinct(F.transform("t", lambda x: x["class"]))
    met = met.withColumn("items", F.array_sort(ids)).withColumn("k", F.explode("items"))
    # inverted index: a rule is looked up by its rarest class only
    rarity = classes.groupBy("class").agg(F.min("n").alias("n_all"))
    posted = rules.select("tokens", F.explode("tokens").alias("class")).join(rarity, "class").groupBy("tokens").agg(F.min_by("class", F.struct("n_all", "class")).alias("k"))
    hits = salted(met, posted, ["k"]).where("size(array_except(tokens, items)) = 0")
    spelled = F.expr("array_sort(transform(tokens, c -> array_min(transform(filter(t, x -> x.class = c), x -> x.token))))")
    return hits.groupBy("url").agg(F.min(spelled).alias("mined"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", labelled: DataFrame | None = None, seed_terms: tuple = SEED_TERMS, support: float = 0.01, confidence: float = 0.9) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), verdict (allow or block) and mined (the tokens of a mined rule, else null).

    Each distinct URL is judged once. Labelled URLs may be given as (url, label); without them URLs
    that a stated rule fits carry its verdict, others are block where a word of the host is a seed
    term, else allow. Mined rules leave out token sets that fewer than ``support`` of the URLs labelled
    block have, and those found in fewer than two. URLs without a host are allowed. Repeated rows are judged
    alike; extra columns stay, of clashing names the new ones. Empty pages give an empty result. A URL may have any
    number of tokens; those that always occur together cost as much as one, but sets of many frequent tokens that come and go
    independently, and none of which says block alone, are all counted.
    """
    kept = pages.drop("host", "path", "rule", "verdict", "mined")
    base, col = numbered(kept, url_col)
    base = base.withColumn("url", F.coalesce(F.col(col).cast("string"), F.lit("")))
    counted = cut(base.groupBy("url").agg(F.count("*").alias("rows")))
    urls = cut(tokens(parsed(counted.select("url"))))
    ruled = cut(salted(urls, stated(urls, rules), ["host", "path"], "left"))
    if labelled is None:
        seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"{kind}:{x}") for x in seed_terms for kind in ("word", "host")]))
        learn = ruled.where("host <> ''").select("tokens", F.coalesce("rule_verdict", F.when(seeded, "block").otherwise("allow")).alias("label"))
    else:
        given = labelled.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("label").cast("string").alias("label"))
        learn = tokens(parsed(given)).where("label IS NOT NULL").select("tokens", "label")
    found, classes = mined_rules(learn, support, confidence)
    verdict = F.coalesce("rule_verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    judged = ruled.join(matched(urls, found, classes), "url", "left").select("url", "host", "path", "rule", verdict.alias("verdict"), "mined")
    old = [F.col(c).alias(n) for c, n in zip(base.columns, kept.columns, strict=False)]
    # URLs that a thousandth of the rows or more have: a thousand hashes at most are broadcast, and their rows are dealt out
    total = counted.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(cut(counted.where(F.col("rows") >= max(1000, total / 1000)).select(F.xxhash64("url").alias("_h"))))
    common = lambda x, how: x.withColumn("_h", F.xxhash64("url")).join(hot, "_h", how).drop("_h")
    out = common(base, "left_anti").join(judged, "url", "left").unionByName(salted(common(base, "left_semi"), common(judged, "left_semi"), ["url"], "left"))
    return out.select(*old, "host", "path", "rule", "verdict", "mined")
