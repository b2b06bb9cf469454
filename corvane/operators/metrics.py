"""Agreement of a partition with labels: contingency tables, information metrics and exact pair counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import f1, safe_ratio
from .corpus import sample_order


def contingency(rows: DataFrame, by: list[str], true: str = "t", pred: str = "k") -> DataFrame:
    """Counts by partition keys, true and predicted label: all metrics start from this small table."""
    return rows.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("k")).agg(F.count("*").alias("n"))


def information(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per partition key: rows, true and predicted labels, mi, ht, hp, homogeneity, completeness, v_measure, nmi (nats)."""
    a = cells.groupBy(*by, "t").agg(F.sum("n").alias("a"))
    b = cells.groupBy(*by, "k").agg(F.sum("n").alias("b"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("tot"))
    full = cells.join(a, [*by, "t"]).join(b, [*by, "k"]).join(total, by)
    mi = full.groupBy(*by).agg(F.sum(F.col("n") / F.col("tot") * F.log(F.col("tot") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    h = lambda side, c, name: side.join(total, by).groupBy(*by).agg(
        (-F.sum(F.col(c) / F.col("tot") * F.log(F.col(c) / F.col("tot")))).alias(f"h_{name}"), F.count("*").alias(f"n_{name}")
    )
    out = total.join(mi, by).join(h(a, "a", "true"), by).join(h(b, "b", "pred"), by)
    hom = F.when(F.col("h_true") == 0, 1.0).otherwise(F.col("mi") / F.col("h_true"))
    com = F.when(F.col("h_pred") == 0, 1.0).otherwise(F.col("mi") / F.col("h_pred"))
    out = out.withColumns({"homogeneity": hom, "completeness": com})
    v = safe_ratio(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness"))
    return out.withColumns({"v_measure": v, "nmi": F.when((F.col("h_true") == 0) & (F.col("h_pred") == 0), 1.0).otherwise(safe_ratio(2 * F.col("mi"), F.col("h_true") + F.col("h_pred")))})


def adjusted_rand(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per partition key: ari, from pair counts of the contingency table."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = cells.groupBy(*by).agg(pairs(F.col("n")).alias("tp"), F.sum("n").alias("tot"))
    same_t = cells.groupBy(*by, "t").agg(F.sum("n").alias("a")).groupBy(*by).agg(pairs(F.col("a")).alias("st"))
    same_k = cells.groupBy(*by, "k").agg(F.sum("n").alias("b")).groupBy(*by).agg(pairs(F.col("b")).alias("sk"))
    x = both.join(same_t, by).join(same_k, by)
    tp, fn, fp = F.col("tp"), F.col("st") - F.col("tp"), F.col("sk") - F.col("tp")
    tn = F.col("tot") * (F.col("tot") - 1) / 2 - tp - fn - fp
    value = 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return x.select(*by, F.when((fp == 0) & (fn == 0), 1.0).otherwise(value).alias("ari"))


def adjusted_mutual_information(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per partition key: emi and ami (arithmetic mean), the expectation over fixed margins being exact.

    The expected sum is taken over the distinct margins, each weighted by how often it occurs. Counts so far from their mean that all of them together have a
    probability below exp(-60), by Bernstein's bound, are beyond a double's digits and are not made.
    """
    a = cells.groupBy(*by, "t").agg(F.sum("n").alias("a")).groupBy(*by, "a").agg(F.count("*").alias("wa"))
    b = cells.groupBy(*by, "k").agg(F.sum("n").alias("b")).groupBy(*by, "b").agg(F.count("*").alias("wb"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("tot"))
    lo, hi = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("tot")), F.least("a", "b")
    mean = F.col("a") * F.col("b").cast("double") / F.col("tot")
    away = 20 + F.sqrt(400 + 120 * mean)
    near = F.greatest(lo, F.floor(mean - away)), F.least(hi, F.ceil(mean + away))
    lf = _log_factorial
    fixed = lf("a") + lf("b") + lf("tot - a") + lf("tot - b") - lf("tot")
    tasks = 4 * int(cells.sparkSession.sparkContext.defaultParallelism)  # few bytes and much work: by bytes alone, all would be one task's
    margins = a.join(b, by).join(total, by).where(lo <= hi).repartition(tasks, *by, "a", "b")
    each = margins.select(*by, "a", "b", "tot", (F.col("wa") * F.col("wb")).alias("w"), fixed.alias("fixed"), F.explode(F.sequence(*near)).alias("n"))
    term = F.col("fixed") - lf("n") - lf("a - n") - lf("b - n") - lf("tot - a - b + n")
    emi = each.groupBy(*by).agg(F.sum(F.col("w") * F.col("n") / F.col("tot") * F.log(F.col("tot") * F.col("n") / (F.col("a") * F.col("b"))) * F.exp(term)).alias("emi"))
    x = information(cells, by).join(emi, by)
    mean = (F.col("h_true") + F.col("h_pred")) / 2
    one = ((F.col("n_true") == 1) & (F.col("n_pred") == 1)) | ((F.col("n_true") == F.col("tot")) & (F.col("n_pred") == F.col("tot")))
    return x.select(*by, "emi", F.when(one, 1.0).otherwise(safe_ratio(F.col("mi") - F.col("emi"), mean - F.col("emi"))).alias("ami"))


def _log_factorial(of: str):
    """ln(n!) by a shifted Stirling series: exact to 1e-12 relative from 0 on, and no table that grows with n."""
    x = f"(({of}) + 10.0D)"
    series = f"(({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1.0D/(12*{x}) - 1.0D/(360*pow({x},3)) + 1.0D/(1260*pow({x},5)) - 1.0D/(1680*pow({x},7)) + 1.0D/(1188*pow({x},9)))"
    shift = " + ".join(f"ln(({of}) + {i}.0D)" for i in range(1, 11))
    return F.expr(f"({series} - ({shift}))")


def external(rows: DataFrame, by: list[str], true: str = "t", pred: str = "k", guard: bool = True) -> DataFrame:
    """ari, ami, nmi, homogeneity, completeness, v_measure; with ``guard`` all 0 if a side has fewer than two labels."""
    return external_of(contingency(rows, by, true, pred).persist(), by, guard)  # label pairs, not rows; six aggregations start from them


def external_of(cells: DataFrame, by: list[str], guard: bool = True) -> DataFrame:
    """The same from a contingency table."""
    x = information(cells, by).join(adjusted_rand(cells, by), by).join(adjusted_mutual_information(cells, by).select(*by, "ami"), by)
    names = ("ari", "ami", "nmi", "homogeneity", "completeness", "v_measure")
    few = (F.col("n_true") < 2) | (F.col("n_pred") < 2)
    return x.select(*by, *((F.when(few, 0.0).otherwise(F.col(c)) if guard else F.col(c)).alias(c) for c in names))


def pair_counts(rows: DataFrame, by: list[str], cluster: str = "k", mask: str = "mask") -> DataFrame:
    """Exact pairwise agreement of clusters and shared labels, from counts of (cluster, mask): never from pairs of rows."""
    return pair_counts_of(rows.groupBy(*by, F.col(cluster).alias("k"), F.col(mask).alias("m")).agg(F.count("*").alias("n")), by)


def pair_counts_of(g: DataFrame, by: list[str]) -> DataFrame:
    """The same from counts n of (k, m)."""
    t = g.groupBy(*by, "m").agg(F.sum("n").alias("n"))

    def shared(x: DataFrame, keys: list[str]) -> DataFrame:
        y = x.select(*keys, F.col("m").alias("m2"), F.col("n").alias("n2"))
        meet = x.join(y, keys) if keys else x.crossJoin(y)
        ordered = meet.where(F.col("m").bitwiseAND(F.col("m2")) != 0).groupBy(*by).agg(F.sum(F.col("n") * F.col("n2")).alias("ordered"))
        own = x.where("m <> 0").groupBy(*by).agg(F.sum("n").alias("own"))
        pair = ordered.join(own, by) if by else ordered.crossJoin(own)
        return pair.select(*by, ((F.col("ordered") - F.col("own")) / 2).cast("long").alias("v"))

    label = shared(t, by).withColumnRenamed("v", "label_pairs")
    tp = shared(g, [*by, "k"]).withColumnRenamed("v", "tp")
    model = g.groupBy(*by, "k").agg(F.sum("n").alias("s")).groupBy(*by).agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).cast("long").alias("model_pairs"), F.sum("s").alias("rows"))
    x = model.join(label, by, "left").join(tp, by, "left") if by else model.crossJoin(label).crossJoin(tp)
    x = x.na.fill(0, ["label_pairs", "tp"])
    x = x.withColumn("total_pairs", (F.col("rows") * (F.col("rows") - 1) / 2).cast("long")).withColumns({"fp": F.col("model_pairs") - F.col("tp"), "fn": F.col("label_pairs") - F.col("tp")})
    x = x.withColumn("tn", F.col("total_pairs") - F.col("tp") - F.col("fp") - F.col("fn"))
    x = x.withColumns({"precision": safe_ratio(F.col("tp"), F.col("model_pairs")), "recall": safe_ratio(F.col("tp"), F.col("label_pairs"))})
    return x.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select(*by, "total_pairs", "model_pairs", "label_pairs", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def random_pairs(rows: DataFrame, pairs: int, seed: int, columns: Sequence[str], key: str = "id") -> DataFrame:
    """``pairs`` distinct unordered pairs of different rows, each as likely as any other; all pairs if there are no more. Columns: a and b, structs of ``columns``.

    Pairs have numbers from 0 to n (n - 1) / 2. If they are few they are all put in a random order; else numbers are drawn, and
    drawn ones that repeat fall out. Rows are numbered in the order of a digest, without a window over all of them.
    """
    from .learn import ranked

    spark = rows.sparkSession
    numbered = ranked(rows.withColumn("__all", F.lit(0)), "__all", sample_order(seed, key)).select("rank", F.struct(*columns).alias("row"))
    n = rows.count()
    total = n * (n - 1) // 2
    few = total <= 2 * pairs
    draws = spark.range(total if few else 2 * pairs)
    order = F.xxhash64(F.lit(seed), "id")
    number = F.col("id") if few else F.pmod(order, F.lit(total))
    drawn = draws.select(number.alias("p")).distinct().orderBy(F.xxhash64(F.lit(seed + 1), "p"), "p").limit(pairs)
    # the larger row number j has j (j - 1) / 2 pairs before it; the root may be off by one
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    before = lambda x: F.expr(f"({x} * ({x} - 1)) div 2")
    drawn = drawn.withColumn("j", j).withColumn("j", F.when(before("j") > F.col("p"), F.col("j") - 1).otherwise(F.col("j")))
    drawn = drawn.withColumn("j", F.when(before("(j + 1)") <= F.col("p"), F.col("j") + 1).otherwise(F.col("j"))).withColumn("i", F.col("p") - before("j"))
    of = lambda end, name: numbered.select(F.col("rank").alias(end), F.col("row").alias(name))
    return drawn.join(of("i", "a"), "i").join(of("j", "b"), "j").select("a", "b")


def sampled_pair_counts(rows: DataFrame, seed: int, max_pairs: int = 1_000_000, cluster: str = "k", mask: str = "mask") -> DataFrame:
    """One row: agreement over all pairs if there are no more than ``max_pairs``, over so many random ones else."""
    n = rows.count()
    total = n * (n - 1) // 2
    if total <= max_pairs:
        found = pair_counts(rows.select(F.col(cluster).alias("k"), F.col(mask).alias("mask")), []).select(F.col("total_pairs").alias("pairs_evaluated"), "tp", "fp", "fn", "tn")
    else:
        same, label = F.col(f"a.{cluster}") == F.col(f"b.{cluster}"), F.col(f"a.{mask}").bitwiseAND(F.col(f"b.{mask}")) != 0
        found = random_pairs(rows, max_pairs, seed, [cluster, mask]).agg(
            F.count("*").alias("pairs_evaluated"), F.count_if(same & label).alias("tp"), F.count_if(same & ~label).alias("fp"), F.count_if(~same & label).alias("fn"), F.count_if(~same & ~label).alias("tn")
        )
    found = found.withColumns({"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return found.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "exact": F.lit(total <= max_pairs), "total_possible_pairs": F.lit(total).cast("long")})


def subsets(rows: DataFrame, macros: str = "macros") -> DataFrame:
    """Each row once for each subset it belongs to: all, excluding_other, single_clear_label, multi_label."""
    m = F.col(macros)
    clear = (F.size(m) > 0) & ~F.array_contains(m, "other")
    names = F.array_compact(F.array(F.lit("all"), F.when(clear, F.lit("excluding_other")), F.when(clear & (F.size(m) == 1), F.lit("single_clear_label")), F.when(F.size(m) > 1, F.lit("multi_label"))))
    return rows.withColumn("subset", F.explode(names))


def suite(rows: DataFrame, by: list[str], true: str = "t", pred: str = "k", mask: str = "mask") -> DataFrame:
    """All metrics of each partition key in one grouped pass over the contingency and mask counts."""
    counts = rows.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("k"), F.col(mask).alias("m")).agg(F.count("*").alias("n")).persist()
    summed = lambda *keys: counts.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
    sizes = summed("k").withColumnRenamed("n", "s")
    totals = sizes.groupBy(*by).agg(F.sum("s").alias("rows"), F.count("*").alias("cluster_count"), F.max("s").alias("top"))
    ent = sizes.join(totals, by).groupBy(*by).agg((-F.sum(F.col("s") / F.col("rows") * F.log2(F.col("s") / F.col("rows")))).alias("cluster_size_entropy"))
    base = totals.withColumn("largest_cluster_share", F.col("top") / F.col("rows")).drop("top").join(ent, by)
    return base.join(external_of(summed("t", "k"), by), by).join(pair_counts_of(summed("k", "m"), by), by)
