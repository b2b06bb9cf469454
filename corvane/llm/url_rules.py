"""URL filter: fixed host rules first, then association rules mined from labelled URLs.

A URL is a set of tokens (scheme, host suffixes, path segments by depth, query keys and values, fragment). FP-growth
mines frequent sets over the labelled URLs with their class as one more item; rules "tokens -> block" are kept from a support and a
confidence on, and none that a rule of fewer tokens with no less confidence covers. Tokens that stand in the same labelled URLs count as
one, and those in all of them as none, so that sets do not multiply by tokens that say the same; no rule is lost but such twins. Rules are matched by an inverted
index: each stands under its rarest token only, joins the URLs that have that token, and fires if the URL has all the
others. A URL no rule fires for is allowed.

The labels are the fixed rules' verdicts on the URLs that they fit: what is mined carries them over to URLs beyond the fixed hosts.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, maybe_broadcast, table

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9  # well above the share of blocked URLs among the labelled ones, which any token reaches by chance
MIN_COUNT = 5  # labelled URLs that a mined set needs whatever the support
BLOCK = "class=block"

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; empty if null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """From the host's end up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rh, rp in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none of null or a text without ``://``."""
    scheme = F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    first = F.transform(labels, lambda x: F.concat(F.lit("label="), x))
    steps = F.filter(F.split(path(url), "/"), lambda x: x != "")
    segments = F.transform(steps, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), x))
    query_ = F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")
    pairs = F.flatten(F.transform(query_, lambda x: F.array(F.concat(F.lit("query="), x), F.concat(F.lit("key="), F.substring_index(x, "=", 1)))))
    mark = F.regexp_extract(url, r"(?s)#(.*)$", 1)
    fragment = F.when(mark != "", F.array(F.concat(F.lit("mark="), mark))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.array(scheme), suffixes, first, segments, pairs, fragment))
    return F.when(url.contains("://"), every).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(rule_id, antecedent, confidence, support, index_token) from (url, blocked)."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, support double, index_token string")
    urls = checkpoint(labelled.select(F.monotonically_increasing_id().alias("basket"), tokens(F.col("url")).alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked")))
    n = urls.count()
    if not n:
        return empty
    least = max(min_support * n, min_count)
    each = urls.select("basket", F.explode("tokens").alias("token"))
    digest = F.xxhash64("basket")
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(digest.cast("decimal(38,0)")).alias("a"), F.bit_xor(digest).alias("b")).where((F.col("n") >= least) & (F.col("n") < n))
    # at most (tokens of a URL) / min_support tokens are left
    spoken = checkpoint(found.groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token"))
    items = each.join(F.broadcast(spoken), "token").unionByName(urls.where("blocked").select("basket", F.lit(BLOCK).alias("token")))
    baskets = checkpoint(items.groupBy("basket").agg(F.collect_set("token").alias("items")).select("items"))
    # the support is a share of the baskets, and those without a frequent token are gone
    support = min(1.0, least / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    sets = checkpoint(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_class = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("hits"))
    rules = with_class.join(sets, "items").where(F.col("hits") >= min_confidence * F.col("freq"))
    rules = checkpoint(rules.select(F.col("items").alias("antecedent"), (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / n).alias("support")).withColumn("rule_id", F.xxhash64("antecedent")))
    # a rule goes if a rule one token shorter is as sure: its parts are looked up by their digest
    parts = rules.where(F.size("antecedent") > 1).select("rule_id", "confidence", F.explode("antecedent").alias("token"), "antecedent")
    parts = parts.select("rule_id", "confidence", F.xxhash64(F.array_remove("antecedent", F.col("token"))).alias("part"))
    covered = parts.join(rules.select(F.col("rule_id").alias("part"), F.col("confidence").alias("part_confidence")), "part")
    covered = covered.where(F.col("part_confidence") >= F.col("confidence")).select("rule_id").distinct()
    kept = rules.join(covered, "rule_id", "left_anti")
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = kept.select("rule_id", F.explode("antecedent").alias("token")).join(single, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("index_token"))
    return kept.join(rarest, "rule_id").select(*empty.columns)


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct url of ``urls`` that a rule fires for: url, rule_id, confidence, support of the surest."""
    seen = urls.select("url").where("url IS NOT NULL").distinct().withColumn("tokens", tokens(F.col("url")))
    index = maybe_broadcast(checkpoint(rules))
    hits = seen.select("url", "tokens", F.explode("tokens").alias("index_token")).join(index, "index_token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "rule_id"))
    return hits.groupBy("url").agg(best.alias("b")).select("url", "b.rule_id", "b.confidence", "b.support")


def judge(pages: DataFrame, labelled: DataFrame | None = None, **mining) -> DataFrame:
    """Columns of ``pages`` plus host, path, rule, verdict, mined_tokens and confidence.

    ``labelled`` has url and blocked (null counts as not blocked); without it, the pages that a fixed rule fits are labelled by its verdict. A null url has no
    host, path, rule or token and is allowed. Of rules that are equally sure the one of the larger support fires, then the one of the larger digest. Repeated rows are
    judged alike; without labelled URLs no rule is mined. Columns that bear a result column's name are replaced.
    """
    pages = pages.drop("mined_tokens", "confidence")
    h, p = host(F.col("url")), path(F.col("url"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    made = pages.withColumns({"host": h, "path": p}).withColumns({"rule": name, "verdict": verdict})
    if labelled is None:
        labelled = made.where(F.col("verdict").isNotNull()).select("url", (F.col("verdict") == "block").alias("blocked"))
    rules = checkpoint(mine(labelled.where(F.col("url").isNotNull()), **mining))
    fired = match(made.where(F.col("verdict").isNull()), rules)
    fired = fired.join(maybe_broadcast(rules.select("rule_id", F.col("antecedent").alias("mined_tokens"))), "rule_id").select(F.col("url").alias("__url"), "mined_tokens", "confidence")
    # null URLs meet nothing, and are spread by their place
    key = F.coalesce("url", F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string")))
    made = made.withColumn("__url", key).join(maybe_broadcast(checkpoint(fired)), "__url", "left").drop("__url")
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return made.withColumn("verdict", F.coalesce("verdict", mined))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined_tokens", " ").alias("mined_tokens"), "confidence")
