"""Every registered query of the reference operators against its SQL, or its invariants."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.plans import ORACLE_SQL, QUERIES

from .comparing import assert_same
from .conftest import SMALL


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["kmeans", "leiden", "agglomerative", "hdbscan"])
def test_each_row_is_labelled_once(spark, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    by = found.groupby("config_id") if "config_id" in found else [(0, found)]
    for _, part in by:
        assert len(part) == part["id"].nunique() == 500
        labels = sorted(set(part["cluster"]) - {-1})
        assert labels == list(range(len(labels)))


def embeddings(spark):
    found = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    return found["vec_id"].to_numpy(), np.stack(found["embedding"]).astype(float), found["label"].to_numpy()


def collected(spark, name):
    return QUERIES[name](spark, SMALL).toPandas()


def test_near_duplicates_against_all_pairs_of_a_block(spark):
    from corvane.functions.text import block_key, normalize_text
    from corvane.operators import neardup

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # variants of some texts, so that blocks hold pairs on both sides of the ratio
    odd = docs.where("doc_id < 40").select((F.col("doc_id") + 1000).alias("doc_id"), F.expr("concat(substring(text, 1, 200), ' and so on ', substring(text, 230))").alias("text"))
    rows = docs.select(F.col("doc_id").alias("id"), "text").unionByName(odd.select(F.col("doc_id").alias("id"), "text"))
    t = normalize_text(F.col("text"))
    entry = rows.groupBy(t.alias("t")).agg(F.min("id").alias("id")).withColumn("block", block_key(F.col("t"))).collect()
    want = {}
    for x in entry:
        for y in entry:
            if x["id"] < y["id"] and x["block"] == y["block"] and 200 * min(len(x["t"]), len(y["t"])) >= 92 * (len(x["t"]) + len(y["t"])):
                r = neardup.ratio(x["t"], y["t"])
                if r >= 92:
                    want[x["id"], y["id"]] = round(r, 6)
    got = {(r["a"], r["b"]): round(r["ratio"], 6) for r in neardup.near_duplicates(rows).collect()}
    assert got == want and len(want) >= 20
    told = neardup.report(rows, 7).collect()
    assert len(told) == 7 and [r["kind"] for r in told] == sorted(r["kind"] for r in told)
    assert {(r["a"], r["b"]) for r in QUERIES["near_duplicates"](spark, SMALL).collect()} <= got.keys()
    assert {r["kind"] for r in QUERIES["duplicate_report"](spark, SMALL).collect()} <= {"exact", "near"}


def test_page_records_hold_all_paragraphs(spark):
    import hashlib
    import html
    import re

    want = Counter()
    for page in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        if re.search("/(en|fr|de|es)/", page["url"] or ""):
            want.update(t for b in re.findall(r"<p>([^<]+)</p>", page["html"] or "") if (t := " ".join(html.unescape(b).split())))
    got = QUERIES["page_records"](spark, SMALL).collect()
    assert Counter(r["text"] for r in got) == want and sum(want.values()) > 50
    for r in got[:50]:
        assert r["rating"] == 5 and str(r["date"])[:10] == "2003-02-01" and r["text_length_chars"] == len(r["text"])
        assert r["id"] == hashlib.sha256(f"2003-2-{r['text']}".casefold().encode()).hexdigest()[:16]


def test_random_pairs_are_all_alike_likely(spark):
    _, v, _ = embeddings(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    every = s[np.triu_indices(len(s), 1)]
    got = collected(spark, "random_pair_similarity").iloc[0]
    assert got["n"] == 20_000 and abs(got["mean"] - every.mean()) < 0.004 and abs(got["std"] - every.std()) < 0.004
    gap = collected(spark, "neighbour_vs_random")
    np.fill_diagonal(s, -1)
    assert gap["mean_difference"].iloc[0] == pytest.approx(s.max(1).mean() - got["mean"], abs=1e-5)


def test_sampled_pairs(spark):
    from corvane.operators import metrics

    rows = spark.range(60).select("id", (F.col("id") % 7).alias("k"), F.expr("shiftleft(1L, CAST(id % 5 AS INT))").alias("mask"))
    assert metrics.sampled_pair_counts(rows, 1, 2000).first()["exact"]
    for most in (1500, 500):  # nearly all pairs, and a small share of them
        pairs = metrics.random_pairs(rows, most, 3, ["id"]).select("a.id", F.col("b.id").alias("other")).collect()
        assert len(pairs) == len({frozenset(p) for p in pairs}) == most and all(len(set(p)) == 2 for p in pairs)
    got = metrics.sampled_pair_counts(rows, 3, 500).first()
    assert (got["exact"], got["total_possible_pairs"], got["pairs_evaluated"]) == (False, 1770, 500)
    assert got["tp"] + got["fp"] + got["fn"] + got["tn"] == 500 and abs((got["tp"] + got["fp"]) / 500 - 0.13) < 0.06
    assert metrics.random_pairs(rows.limit(1), 10, 3, ["id"]).count() == 0


@pytest.mark.parametrize("name", ["dedup_keep_first", "dup_groups_all", "duplicate_records", "tag_merge_on_dedup"])
def test_texts_are_normalised_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") >= 2  # all sides start from the kept digests


def test_beyond_a_million_pairs_there_is_no_row_as_in_the_sql(spark, duck, tmp_path):
    from .comparing import assert_same

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + F.lit(1_000_000).cast(docs.schema["doc_id"].dataType))).crossJoin(spark.range(4)).withColumn("doc_id", F.col("doc_id") + 10_000_000 * F.col("id")).drop("id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    con = duck.cursor()
    for t in ("documents", "labels"):
        con.execute(f"CREATE TEMP VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["pairwise_sampled"]).df()
    assert len(want) == 0
    assert_same(QUERIES["pairwise_sampled"](spark, str(tmp_path)).toPandas(), want)


def test_internal_metrics_agree_with_their_own_queries(spark):
    got = collected(spark, "internal_metrics").set_index("metric")["value"]
    for name in ("silhouette", "calinski_harabasz", "davies_bouldin", "modularity"):
        assert got[name] == pytest.approx(collected(spark, name).iloc[0, 0], abs=1e-5)
    from corvane.operators import vectors

    one = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "id long, v array<double>, cluster long")
    broken = {r["metric"]: r for r in vectors.internal(one, graph=lambda: 1 / 0).collect()}
    assert broken["modularity"]["value"] is None and "ZeroDivisionError" in broken["modularity"]["reason"]


def test_projections_keep_the_variance_of_the_leading_axes(spark):
    ids, v, _ = embeddings(spark)
    values = np.linalg.eigvalsh(np.cov(v.T))[::-1]
    assert collected(spark, "pca_variance")["variance"][0] == pytest.approx(values[:16].sum() / values.sum(), abs=1e-5)
    flat = collected(spark, "plot_layout").set_index("id").loc[ids][["x", "y", "z"]].to_numpy()
    assert np.allclose(np.cov(flat.T), np.diag(values[:3]), atol=1e-4) and np.allclose(flat.mean(0), 0, atol=1e-4)


def test_structural_vectors_are_standardised_features(spark):
    from corvane.operators.features import STRUCTURE

    flat = collected(spark, "structural_features").set_index("id").sort_index()
    x = flat[list(STRUCTURE)].to_numpy(float)
    std = x.std(0)
    z = np.where(std > 0, (x - x.mean(0)) / np.where(std > 0, std, 1), 0)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    got = np.stack(collected(spark, "structural_vectors").sort_values("id")["v"])
    assert np.allclose(got, z, atol=1e-4)


def test_hashed_embedding_by_hand(spark):
    import regex
    import xxhash

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 12").collect()}
    got = collected(spark, "hashed_embedding").set_index("id")["v"]
    for i, text in docs.items():
        t = regex.findall(r"[\p{L}\p{N}_]{2,}", (text or "").lower())
        want = np.zeros(256)
        for term in t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)]:
            h = xxhash.xxh64_intdigest(term.encode(), 42)
            want[h % 256] += -1 if h >> 63 else 1
        assert np.allclose(got[i], want / max(np.linalg.norm(want), 1e-300), atol=1e-6)


def test_pair_statistics_count_the_pairs(spark):
    pairs = collected(spark, "pair_sampling")
    want = pairs.groupby(["y", "source"]).size().to_dict()
    assert {(r["y"], r["source"]): r["n"] for r in QUERIES["pair_statistics"](spark, SMALL).collect()} == want
    assert not pairs.duplicated(["a", "b", "y"]).any()


def test_training_pairs_stay_in_the_training_rows(spark):
    split = collected(spark, "holdout_split").set_index("id")["split"]
    pairs = collected(spark, "pair_sampling")
    assert {"positive", "random", "hard"} == set(pairs["source"])
    assert set(split.loc[pairs["a"]]) == set(split.loc[pairs["b"]]) == {"train"}


def test_a_stratum_of_one_row_gives_up_the_strata(spark):
    from corvane.operators import learn

    rows = spark.range(50).select("id", F.when(F.col("id") == 7, "lone").otherwise("many").alias("s"))
    got = Counter(r["split"] for r in learn.split_rows(rows, "s", 1, (0.6, 0.2, 0.2), ("train", "validation", "holdout")).collect())
    assert got == {"train": 30, "validation": 10, "holdout": 10}


def test_pairs_are_of_their_kind(spark):
    from corvane.plans.base import labelled

    macros = {r["id"]: set(r["macros"]) for r in labelled(spark, SMALL).collect()}
    found = QUERIES["pair_sampling"](spark, SMALL).collect()
    assert {r["source"] for r in found} >= {"positive", "random"}
    for r in found:
        assert r["a"] < r["b"]
        assert bool(macros[r["a"]] & macros[r["b"]]) == (r["y"] == 1)


def test_linkage_runs_that_cannot_be_made_are_rows(spark, monkeypatch):
    from corvane.operators import cluster

    monkeypatch.setattr(cluster, "EXACT_ROWS", 10)
    got = {r["config_id"]: r for r in QUERIES["cluster_search"](spark, SMALL).collect()}
    assert {i for i, r in got.items() if r["score"] == -999 and "at most" in r["reason"]} == {10, 11, 20}
    assert {i for i, r in got.items() if r["reason"] is None} == {0, 1, 2, 38, 42}
    assert all(r["id"] is None and r["reason"] for q in ("agglomerative", "hdbscan") for r in QUERIES[q](spark, SMALL).collect())
