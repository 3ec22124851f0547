"""URL filters: rules by host and path, and association rules of URL tokens mined from what those rules label."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_below, cut, read

#: (host and path, verdict). Fixed values.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Share of the labelled pages, and number of them, that a rule must hold for; the greater counts.
SUPPORT, LEAST = 0.002, 3
CONFIDENCE = 0.7
#: Confidence that a longer rule must add to a shorter one that it contains.
GAIN = 0.01
DEFAULT = "allow"
LABEL = "verdict="
#: Mined rules, and tokens that stand for one another, up to this many are broadcast.
BROADCAST_RULES = 100_000


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str) -> Column:
    """Whether a rule fits the columns host and path: its host or a subdomain, and a path that starts as the rule's does."""
    h, slash, p = rule.partition("/")
    return ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(slash + p)


def by_rules(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. The rules are written by hand, so they are few."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        rule, verdict = F.when(fits(r), r).otherwise(rule), F.when(fits(r), v).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of the columns host and path: labels of the host, the last one marked, the first marked if it isn't
    of the registered name; words of the path, a dot's ending marked, digits alone left out."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    named = F.transform(labels, lambda x, i: F.concat(F.when(i == F.size(labels) - 1, "tld:").when(i < F.size(labels) - 2, "sub:").otherwise("name:"), x))
    words = F.filter(F.split(F.lower("path"), r"[/\-_.,;=&%+~]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    return F.array_distinct(F.concat(named, F.transform(words, lambda x: F.concat(F.lit("path:"), x))))


def alike(urls: DataFrame, least: int) -> DataFrame:
    """(token, item, pure, verdict, n) of the tokens of urls(url_key, tokens, verdict) in `least` rows at least.

    Tokens that stand in exactly the same rows are one item, named by the smallest of them: sums of two hashes of the rows'
    keys tell. A pure token stands in rows of one verdict only and is an item of its own.
    """
    each = urls.select("url_key", "verdict", F.explode("tokens").alias("token"))
    half = F.pmod(F.xxhash64("url_key"), F.lit(1 << 40))
    other = F.pmod(F.xxhash64("url_key", F.lit(1)), F.lit(1 << 40))
    t = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(half).alias("s0"), F.sum(other).alias("s1"), F.min("verdict").alias("low"), F.max("verdict").alias("verdict"))
    t = cut(t.filter(F.col("n") >= least).withColumn("pure", F.col("low") == F.col("verdict")))
    item = t.filter(~F.col("pure")).groupBy("n", "s0", "s1").agg(F.min("token").alias("item")).select(F.col("n").alias("i_n"), F.col("s0").alias("i0"), F.col("s1").alias("i1"), "item")
    named = t.filter(~F.col("pure")).join(item, (F.col("n") == F.col("i_n")) & (F.col("s0") == F.col("i0")) & (F.col("s1") == F.col("i1")))
    cols = ["token", "item", "pure", "verdict", "n"]
    return named.select(*cols).union(t.filter("pure").withColumn("item", F.col("token")).select(*cols))


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(rules, items): rules (rule_id, tokens, verdict, confidence, support) mined by FP-growth from urls(tokens, verdict), and
    items (token, item) of the tokens that another stands for in rules.

    Every row is a transaction, so a URL of many pages counts as often. Of the frequent sets that hold a verdict, those are
    rules that are confident enough and at least GAIN more so than each shorter rule for the same verdict that they
    contain. So a token of one verdict only is a rule by itself and never part of a longer one, and needs no mining; and of
    tokens that always stand together one is mined for all. What is left has few items a URL, however many words it has, and
    a set must hold for `least` rows, whatever the share. No labelled URL gives no rule.
    """
    spark = urls.sparkSession
    urls = cut(urls.withColumn("url_key", F.monotonically_increasing_id()))
    n = urls.count()
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double"), spark.createDataFrame([], "token string, item string")
    if not n:
        return empty
    count = max(least, -(-int(round(support * n * 1e6)) // 1_000_000))
    t = cut(alike(urls, count))
    pure = t.filter("pure").select(F.array("token").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / n).alias("support"))
    items = t.filter("not pure").select("token", "item")
    each = urls.select("url_key", "verdict", F.explode_outer("tokens").alias("token")).join(broadcast_below(items, BROADCAST_RULES), "token", "left")
    rows = each.groupBy("url_key", "verdict").agg(F.collect_set("item").alias("set")).select(F.concat("set", F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / n, minConfidence=confidence).fit(rows)
    long = model.associationRules.filter(F.col("consequent")[0].startswith(LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1 << 20).alias("verdict"), "confidence", "support"
    )
    found = cut(long.union(pure))
    # each rule's shorter ones are found by its own subsets, one token left out at a time
    less = found.withColumn("drop", F.explode("tokens")).select(F.array_remove("tokens", F.col("drop")).alias("s"), F.col("tokens").alias("of"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    worse = less.join(found, (F.col("s") == F.col("tokens")) & (F.col("v") == F.col("verdict")) & (F.col("c") < F.col("confidence") + GAIN)).select("of", "v").distinct()
    kept = found.join(worse, (F.col("tokens") == F.col("of")) & (F.col("verdict") == F.col("v")), "left_anti")
    return cut(kept.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", "support")), cut(items.filter("token <> item"))


def as_items(urls: DataFrame, items: DataFrame) -> DataFrame:
    """urls(url_key, tokens) with each token that another stands for also as that one."""
    if not items.limit(1).count():
        return urls
    i = items.select(F.col("token").alias("i_token"), "item")
    each = urls.select("url_key", F.explode("tokens").alias("token")).join(broadcast_below(i, BROADCAST_RULES), F.col("token") == F.col("i_token"))
    more = each.groupBy(F.col("url_key").alias("m_key")).agg(F.collect_set("item").alias("more"))
    return urls.join(more, F.col("url_key") == F.col("m_key"), "left").select("url_key", F.array_union("tokens", F.coalesce("more", F.array().cast("array<string>"))).alias("tokens"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_key, verdict) of urls(url_key, tokens) that a rule matches: the most confident, then best supported, longest, smallest one's.

    Each rule stands in an inverted index under its rarest token among the rules; a URL's tokens look the index up, and
    what they find is checked against all of the URL's tokens.
    """
    each = rules.select("rule_id", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule_id").orderBy("n", "token")
    index = each.join(common, "token").withColumn("k", F.row_number().over(rarest)).filter("k = 1").select("rule_id", F.col("token").alias("key"))
    index = cut(index.join(rules, "rule_id").select("key", F.col("tokens").alias("needs"), "verdict", "confidence", "support"))
    found = urls.select("url_key", "tokens", F.explode("tokens").alias("token")).join(broadcast_below(index, BROADCAST_RULES), F.col("token") == F.col("key"))
    fit = found.filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.struct("confidence", "support", F.size("needs").alias("n"), "needs")
    return fit.groupBy("url_key").agg(F.max_by("verdict", best).alias("verdict"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages(page_id, url).

    Where no rule fits, the verdict is that of the best mined rule, learned from the pages that rules do fit, and allow
    where none matches. Tokens are matched once for each distinct (host, path); null and odd urls have empty host and
    path; null ids and repeated rows are kept; an empty table gives an empty one; other columns are ignored.
    """
    p = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = by_rules(rules)
    p = p.withColumns({"rule": rule, "base": verdict})
    places = cut(p.groupBy("host", "path").agg(F.first("base").alias("base")).withColumns({"tokens": tokens(), "url_key": F.xxhash64("host", "path")}))
    labelled = p.filter(F.col("base").isNotNull()).select(tokens().alias("tokens"), F.col("base").alias("verdict"))
    mined, items = mine(labelled, support, confidence)
    m = match(as_items(places.filter(F.col("base").isNull()).select("url_key", "tokens"), items), mined)
    m = cut(places.filter(F.col("base").isNull()).join(m, "url_key").select(F.col("host").alias("m_host"), F.col("path").alias("m_path"), F.col("verdict").alias("mined")))
    out = p.join(m, (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("base", "mined", F.lit(DEFAULT)).alias("verdict"))


def op4_url(spark, sf_dir) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
