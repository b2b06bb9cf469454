"""Feature spaces, ablation, search, supervised and label-guided experiments."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import cluster, search, spaces
from corvane.plans import QUERIES, catalogue

from .conftest import SMALL


@pytest.fixture(scope="module")
def wide(spark):
    """A small catalogue: the stored vectors, and spaces of few dimensions beside them."""
    rng = np.random.default_rng(4)
    centres = {c: rng.normal(size=(4, 12)) for c in spaces.BASE}
    rows = []
    for i in range(160):
        rows.append((i, *((lambda x: (x / np.linalg.norm(x)).tolist())(centres[c][i % 4] + 0.2 * rng.normal(size=12)) for c in spaces.BASE)))
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} array<double>" for c in spaces.BASE)).cache()


@pytest.fixture(scope="module")
def truth(spark):
    rows = [(i, "abcd"[i % 4], ["abcd"[i % 4]] if i % 9 else ["other"], 1 << (i % 4)) for i in range(160)]
    return spark.createDataFrame(rows, "id long, t string, macros array<string>, mask long").cache()


def test_svd_against_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    dense = rng.random((90, 40)) * (rng.random((90, 40)) < 0.2)
    dense[5] = 0
    rows = [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(dense)]
    matrix = spark.createDataFrame(rows, "id long, at array<int>, w array<double>").repartition(3)
    v, values = spaces.truncated_svd(matrix, 40, 6, iterations=12)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    assert np.allclose(values, np.linalg.svd(dense, compute_uv=False)[:6], rtol=1e-3)
    got = np.stack([r["v"] for r in spaces.project(matrix, v).orderBy("id").collect()])
    want = dense @ v
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)) and not got[5].any()
    assert spaces.truncated_svd(matrix, 0)[0].shape == (0, 0)


def test_sparse_rows_take_their_vocabulary_from_training_rows(spark):
    rows = spark.createDataFrame([(1, "aa bb", True), (2, "aa bb cc", True), (3, "cc dd", False), (4, "dd dd", False), (5, None, True), (6, "aa", True)], "id long, text string, train boolean")
    from corvane.operators.features import word_grams

    matrix, size = spaces.sparse_rows(rows, word_grams(F.col("text")), F.col("train"), 10)
    got = {r["id"]: (r["at"], r["w"]) for r in matrix.collect()}
    assert size == 3  # aa, bb and "aa bb" stand in two training rows or more; cc in one
    assert got[3] == got[4] == got[5] == ([], []) and len(got[1][0]) == 3
    assert all(abs(sum(x * x for x in w) - 1) < 1e-9 for _, w in got.values() if w)


def test_terms_are_counted_where_their_row_is(spark, monkeypatch):
    from corvane.operators import features

    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abé𝒳"), rng.integers(1, 7))) for _ in range(rng.integers(0, 30))) for _ in range(60)] + [None, "", "  a\u00a0b "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    monkeypatch.setattr(features, "UNITS_AT_ONCE", 50)
    monkeypatch.setattr(features, "TERMS_AT_ONCE", 40)
    each = rows.select("id", F.explode(features.char_grams(F.col("text"))).alias("term")).groupBy("id", "term").count().groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("total")).where("df >= 2 AND df <= 0.95 * 63")
    want = [tuple(r) for r in each.orderBy(F.desc("total"), "term").limit(30).collect()]
    found = features.vocabulary(rows, features.blank_words(F.col("text")), 2, 0.95, 30, features.char_pieces)
    assert [tuple(r) for r in found.collect()] == want
    matrix, size = spaces.sparse_rows(rows, features.blank_words(F.col("text")), None, 30, pieces=features.char_pieces)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert size == 30 and plan.count("Exchange") <= 1  # the repartition above: no row's terms are shuffled


def test_regressions_learn_from_every_training_row(spark):
    from corvane.operators import learn

    rows = [(i, "train" if i < 900 else "test", ["a"] if i % 3 else ["b"], [i % 3], [1.0]) for i in range(1000)]
    made = spark.createDataFrame(rows, "id long, split string, macros array<string>, at array<int>, w array<double>")
    assert not hasattr(learn, "TRAIN_ROWS")
    coef = learn.fit_one_vs_rest(made.where("split = 'train'").select(F.array(F.array_contains("macros", "a").cast("double"), F.array_contains("macros", "b").cast("double")).alias("y"), F.col("at").alias("at0"), F.col("w").alias("w0")), [3], [[0]], 2)[0]
    p = 1 / (1 + np.exp(-(coef[:3] + coef[3])))
    g = (p - [[0, 1], [1, 0], [1, 0]]) / 3 + 1e-4 * coef[:3]
    assert np.abs(g).max() < 1e-3 and p[0, 0] < 0.1 and p[1, 0] > 0.9


def test_names_of_sets_spell_their_weights():
    sets = spaces.weighted_sets()
    assert len(sets) == 86
    for name, weights in sets.items():
        assert spaces.weights_of(name) == weights
    with pytest.raises(KeyError):
        spaces.weights_of("unknown")


def test_catalogue_has_unit_vectors_of_all_sets(spark):
    got = QUERIES["feature_catalogue"](spark, SMALL).toPandas()
    assert len(got) == 200 and list(got.columns) == ["id", *spaces.SETS]
    for name in spaces.SETS:
        n = np.linalg.norm(np.stack(got[name]), axis=1)
        assert (np.isclose(n, 1) | np.isclose(n, 0)).all() and (n > 0.5).mean() > 0.9


def test_minibatch_kmeans_finds_the_groups_of_every_set(wide, truth):
    sets = {k: v for k, v in list(spaces.weighted_sets().items())[:9]}
    found = search.minibatch_kmeans(wide, sets, 4)
    assert found.count() == 9 * 160
    scored = search.evaluate(found, truth, ["feature_set"]).toPandas()
    assert len(scored) == 9 and (scored["ari_all"] > 0.95).all() and (scored["cluster_count"] == 4).all()
    assert set(scored.columns) >= {f"{m}_{s}" for m in ("ari", "ami", "v_measure") for s in search.SUBSETS.values()}


def test_the_grid_has_all_runs():
    runs = search.grid(["dense_lexical", "dense_lexical_structural", "structural"])
    assert len(runs) == 1080 and len(set(runs)) == 1080
    per = {m: sum(r.method == m for r in runs) for m in ("leiden", "kmeans", "agglomerative", "hdbscan")}
    assert per == {"leiden": 972, "kmeans": 54, "agglomerative": 36, "hdbscan": 18}


RUNS = [*search.leiden_runs("dense", (10,), (0.5,), (1, 7)), search.Run("word", "kmeans", "n_clusters=4", 4), search.Run("char", "agglomerative", "n_clusters=4;linkage=average", 4), search.Run("dense", "hdbscan", "min_cluster_size=10;min_samples=5;method=eom", 10)]


def test_runs_are_scored_and_replayed(wide, truth):
    bad = search.Run("nowhere", "kmeans", "n_clusters=4", 4)
    got = search.search(wide, truth, [*RUNS, bad]).collect()
    assert [r["feature_set"] for r in got][-1] == "nowhere" and got[-1]["balanced_score"] == -999 and "KeyError" in got[-1]["reason"]
    assert all(r["ari_all"] > 0.9 and r["rows"] == 160 for r in got[:-1])
    best = got[0].asDict()
    again = search.replay(wide, best).toPandas().set_index("id")["cluster"]
    first = search.label_runs(wide, [*RUNS, bad]).where(F.col("run") == best["run"]).toPandas().set_index("id")["cluster"]
    assert again.to_dict() == first.to_dict()
    with pytest.raises(ValueError, match="KeyError"):
        search.replay(wide, got[-1].asDict())


def test_above_the_bound_linkage_runs_are_rows_and_the_others_go_on(wide, truth, monkeypatch):
    monkeypatch.setattr(cluster, "EXACT_ROWS", 10)
    got = {r["run"]: r for r in search.search(wide, truth, RUNS).collect()}
    assert {i for i, r in got.items() if r["balanced_score"] == -999 and "at most" in r["reason"]} == {3, 4}
    assert all(got[i]["ari_all"] > 0.9 for i in (0, 1, 2))


def test_supervised_scores_of_four_sets(spark):
    got = QUERIES["supervised_baselines"](spark, SMALL).toPandas()
    assert sorted(zip(got["feature_set"], got["split"], strict=True)) == sorted((s, p) for s in ("word", "char", "dense", "hybrid") for p in ("validation", "test"))
    split = QUERIES["stratified_split"](spark, SMALL).toPandas()
    assert (got[got["split"] == "test"]["rows"] == (split["split"] == "test").sum()).all()
    assert got[got["feature_set"] == "word"]["micro_f1"].min() > 0.4 and got.filter(like="f1").ge(0).all().all() and got.filter(like="f1").le(1).all().all()


def test_one_vs_rest_scores_a_plain_rule(spark):
    from corvane.operators.learn import force_one, multilabel_scores, sparse_one_vs_rest

    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        at = sorted(rng.choice(20, 6, replace=False).tolist())
        rows.append((i, "train" if i < 300 else "test", [x for x, c in (("a", 3), ("b", 7)) if c in at] or ["c"], at, [0.4] * 6))
    scores = sparse_one_vs_rest(spark.createDataFrame(rows, "id long, split string, macros array<string>, at array<int>, w array<double>"), 20, ["a", "b", "c"]).where("split = 'test'")
    assert multilabel_scores(force_one(scores).join(scores.select("id", "label", "y"), ["id", "label"])).first()["micro_f1"] > 0.95


def test_label_guided_projection(spark):
    made, losses = catalogue.guided(spark, SMALL)
    x = {r["id"]: np.array(r["dense"]) for r in made.collect()}
    assert losses[-1] < losses[0] and all(abs(np.linalg.norm(v) - 1) < 1e-9 and len(v) == 64 for v in x.values())
    pairs = [p for p in QUERIES["pair_sampling"](spark, SMALL).collect() if p["a"] in x and p["b"] in x]
    near = {source: np.mean([x[p["a"]] @ x[p["b"]] for p in pairs if p["source"] == source]) for source in ("positive", "random")}
    assert near["positive"] > near["random"]


def test_regression_scores_both_splits(spark):
    got = QUERIES["ovr_logistic"](spark, SMALL).toPandas()
    assert sorted(got["split"]) == ["test", "validation"] and got["micro_f1"].between(0.2, 1).all()
