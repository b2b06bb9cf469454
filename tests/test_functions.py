"""Hand-computed cases, brute-force versions and properties of the reference operators."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as fn
from corvane.operators import cluster, corpus, knn, labels, learn, metrics, neardup, select
from corvane.sources import config, html, sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("  a\n\t b  ", "a b"), (None, ""), ("ﬁ​x", "fix"), ("a  b", "a b"), ("é", "é"), ("²", "2")])
def test_normalize_text(spark, given, wanted):
    assert one(spark, fn.normalize_text(F.lit(given).cast("string"))) == wanted


def test_hash_ignores_case_and_blanks(spark):
    assert one(spark, fn.text_hash(F.lit("Привет"))) == one(spark, fn.text_hash(F.lit(" привет ")))
    assert one(spark, fn.text_hash(F.lit("Straße"))) == one(spark, fn.text_hash(F.lit("STRASSE")))


def test_small_functions(spark):
    assert one(spark, fn.count_words(F.lit("раз два, три"))) == 3
    assert one(spark, fn.normalize_tag(F.lit("  Путин "))) == "путин"
    assert one(spark, fn.truncate(F.lit("abc defg"), 5)) == "abc…"
    assert one(spark, fn.parse_json_list(F.lit('["a", 1]'))) == ["a", "1"]
    assert one(spark, fn.parse_json_list(F.lit('"x"'))) == ["x"]
    assert one(spark, fn.parse_json_list(F.lit(None).cast("string"))) == []
    assert one(spark, fn.parse_params(F.lit("k=30;res = 1.0;w=a=b"))) == {"k": "30", "res": "1.0", "w": "a=b"}
    assert one(spark, fn.parse_rating(F.lit("+12"), F.lit(None).cast("string"))) == 12
    assert one(spark, fn.parse_rating(F.lit("x"), F.lit("7;8"))) is None
    assert one(spark, fn.parse_rating(F.lit(None).cast("string"), F.lit("7;8"))) == 7


def test_mapping_order_wins(spark):
    mapping = config.mapping_table(spark, {"a": ["x"], "b": ["y"]})
    rows = spark.createDataFrame([(1, 0, ["y", "X "]), (2, 0, ["unknown"]), (3, 0, [])], "id long, cl int, tags array<string>")
    found = {r["id"]: (r["macros"], r["unmapped"]) for r in labels.map_tags(rows, mapping).collect()}
    assert found == {1: (["a", "b"], []), 2: (["other"], ["unknown"]), 3: (["other"], [])}


def test_hierarchy_is_disjoint():
    with pytest.raises(ValueError, match="x is below"):
        config.check_hierarchy({"a": ["x"], "b": ["x"]})


def pairs(rows):
    tp = model = label = 0
    for i, (k, m) in enumerate(rows):
        for k2, m2 in rows[:i]:
            model += k == k2
            label += bool(m & m2)
            tp += k == k2 and bool(m & m2)
    return model, label, tp


def test_pair_counts_by_hand(spark):
    rows = [(0, 1), (0, 3), (1, 4), (1, 2)]
    got = metrics.pair_counts(spark.createDataFrame(rows, "k int, mask long"), []).first()
    assert (got["total_pairs"], got["model_pairs"], got["label_pairs"], got["tp"], got["fp"], got["fn"], got["tn"]) == (6, 2, 2, 1, 1, 1, 3)
    assert got["precision"] == got["recall"] == got["f1"] == 0.5


def test_pair_counts_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(16)) for _ in range(120)]
    got = metrics.pair_counts(spark.createDataFrame(rows, "k int, mask long"), []).first()
    assert (got["model_pairs"], got["label_pairs"], got["tp"]) == pairs(rows)


def emi(a, b, n):
    lf = lambda x: math.lgamma(x + 1)
    out = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = math.exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(k) - lf(x - k) - lf(y - k) - lf(n - x - y + k))
                out += k / n * math.log(n * k / (x * y)) * p
    return out


def test_information_metrics(spark):
    rng = random.Random(5)
    rows = [("abc"[rng.randrange(3)], rng.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string, k int").withColumn("g", F.lit(0))
    got = metrics.external(df, ["g"]).first()
    a = [sum(t == x for t, _ in rows) for x in "abc"]
    b = [sum(k == x for _, k in rows) for x in range(4)]
    assert metrics.adjusted_mutual_information(metrics.contingency(df, ["g"]), ["g"]).first()["emi"] == pytest.approx(emi(a, b, 200), abs=1e-9)
    assert got["nmi"] == pytest.approx(got["v_measure"])
    same = metrics.external(df.withColumn("k", F.ascii("t")), ["g"]).first()
    assert same["ari"] == pytest.approx(1) and same["ami"] == pytest.approx(1)
    few = metrics.external(df.withColumn("k", F.lit(1)), ["g"]).first()
    assert few["ari"] == few["ami"] == few["v_measure"] == 0


def test_subsets(spark):
    rows = spark.createDataFrame([(1, ["p"]), (2, ["p", "m"]), (3, ["other"]), (4, ["f"])], "id long, macros array<string>")
    n = {r["subset"]: r["count"] for r in metrics.subsets(rows).groupBy("subset").count().collect()}
    assert n == {"all": 4, "excluding_other": 3, "single_clear_label": 2, "multi_label": 1}


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_ratio_against_the_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        assert neardup.ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    assert neardup.ratio("", "") == 100


def test_near_duplicates(spark):
    base = "the same beginning of a text that goes on and on until it ends"
    rows = spark.createDataFrame([(1, base), (2, base + "."), (3, base), (4, "something else"), (5, None), (6, base[:30] + " but then all is other than before")], "id long, text string")
    assert [(r["a"], r["b"]) for r in neardup.near_duplicates(rows).collect()] == [(1, 2)]
    assert sorted((r["id"], r["kept"]) for r in neardup.exact_groups(rows).collect()) == [(1, 1), (3, 1)]


def test_common_subsequences_of_many_texts_at_once():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé𝒳") for _ in range(n))
    for _ in range(40):
        many, b = [text(rng.randrange(40)) for _ in range(5)], text(rng.randrange(40))
        assert neardup.common_subsequences([neardup._masks(a) for a in many], [len(a) for a in many], b).tolist() == [lcs(a, b) for a in many]


def test_report_looks_for_near_duplicates_only_where_copies_are_fewer(spark, monkeypatch):
    base = "the same beginning of a text that goes on and on until it ends"
    rows = spark.createDataFrame([(1, base), (2, base + "."), (3, base), (4, base)], "id long, text string")
    assert [(r["kind"], r["id"], r["similar_id"]) for r in neardup.report(rows, 3).collect()] == [("exact", 3, 1), ("exact", 4, 1), ("near", 1, 2)]
    monkeypatch.setattr(neardup, "near_duplicates", None)
    assert [(r["kind"], r["id"]) for r in neardup.report(rows, 2).collect()] == [("exact", 3), ("exact", 4)]


@pytest.mark.parametrize("part_rows", [3, 256])
def test_parts_of_a_block_find_all_pairs_and_carry_no_pair_of_texts(spark, monkeypatch, part_rows):
    monkeypatch.setattr(neardup, "PART_ROWS", part_rows)
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 90))]
        for _ in range(5):
            for _ in range(rng.randrange(5)):
                base[rng.randrange(len(base))] = rng.choice("abcdefgh")
            texts.append("the same beginning of all " + "".join(base).strip())
    texts = sorted({" ".join(t.split()) for t in texts})
    want = {(i, j): neardup.ratio(a, b) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if neardup.ratio(a, b) >= 92}
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert {(r["a"], r["b"]): r["ratio"] for r in found.collect()} == want and len(want) > 20
    assert "ta#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5)).round(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    whole = knn.knn(df, 4).toPandas().sort_values(["id", "rank"])
    parts = knn.knn(df, 4, block_rows=13).toPandas().sort_values(["id", "rank"])
    assert whole["neighbour"].tolist() == parts["neighbour"].tolist()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(60):
        d = np.round(1 - u @ u[i], 9)
        want = [j for j in sorted(range(60), key=lambda j: (d[j], j)) if j != i][:4]
        assert whole[whole["id"] == i]["neighbour"].tolist() == want


def test_a_block_of_neighbours_is_found_in_tiles(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    table = lambda ids, v, a, b: pa.table({a: ids, b: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1])})
    q, b = rng.normal(size=(1024, 8)), rng.normal(size=(20_000, 8))
    args = table(np.arange(1024), q, "id", "v"), table(np.arange(20_000) + 5000, b, "base_id", "base_v")
    tracemalloc.start()
    knn._nearest(5, "cosine")(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all distances of the blocks are 164 MB
    v, ids = rng.normal(size=(300, 3)).round(1) + 0.01, rng.permutation(900)[:300]
    monkeypatch.setattr(knn, "BASE_AT_ONCE", 40)
    monkeypatch.setattr(knn, "QUERIES_AT_ONCE", 16)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for metric, d in (("cosine", np.round(1 - u @ u.T, 9)), ("euclidean", np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9))):
        got = knn._nearest(4, metric)(table(ids, v, "id", "v"), table(ids, v, "base_id", "base_v")).to_pandas().groupby("id")["neighbour"].apply(list)
        for i in range(300):
            assert got[ids[i]] == [x for _, x in sorted((d[i, j], ids[j]) for j in range(300) if j != i)[:4]]


def test_a_fit_has_no_more_tasks_than_cores_need(spark, monkeypatch):
    rows = spark.range(60).select("id", F.array(F.col("id") % 2 + F.lit(0.0), F.lit(1.0)).alias("v"), F.lit("train").alias("split"), F.array(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("macros")).repartition(40)
    seen = []
    for owner, name in ((cluster, "KMeans"), (learn, "LogisticRegression")):
        fit = getattr(owner, name).fit
        monkeypatch.setattr(getattr(owner, name), "fit", lambda self, d, *a, fit=fit: seen.append(d.rdd.getNumPartitions()) or fit(self, d, *a))
    assert cluster.kmeans(rows, 2, seeds=(0,)).count() == 60 and learn.one_vs_rest(rows, ["a", "b"]).count() == 120
    assert len(seen) == 3 and max(seen) <= 2 * spark.sparkContext.defaultParallelism


def test_leiden_finds_cliques():
    edges = [(a + c, b + c) for c in (0, 6, 12) for a in range(6) for b in range(a)] + [(0, 6), (6, 12)]
    src, dst = (np.array(x) for x in zip(*edges, strict=True))
    found = cluster.leiden_labels(18, src, dst, np.ones(len(edges)))
    assert len(set(found)) == 3 and all(len(set(found[c : c + 6])) == 1 for c in (0, 6, 12))


def test_leiden_ends_where_no_move_gains():
    rng = np.random.default_rng(2)
    group = rng.integers(0, 6, 4000)
    by = [np.flatnonzero(group == g) for g in range(6)]
    src = np.repeat(np.arange(4000), 8)
    dst = np.where(rng.random(len(src)) < 0.85, np.array([rng.choice(by[group[v]]) for v in src]), rng.integers(0, 4000, len(src)))
    apart = src != dst
    src, dst = src[apart], dst[apart]
    weight = rng.random(len(src))
    began = time.process_time()
    found = cluster.leiden_labels(4000, src, dst, weight, 1.0, 7)
    assert time.process_time() - began < 20  # a queue of nodes took more than that
    assert sorted(set(found)) == list(range(found.max() + 1)) and (np.diff(np.bincount(found)) <= 0).all()
    assert found.tolist() == cluster.leiden_labels(4000, src, dst, weight, 1.0, 7).tolist()
    assert np.mean([np.bincount(found[m]).max() / len(m) for m in by]) > 0.95


def test_stability_is_over_the_whole_grid(spark, tmp_path):
    from corvane.plans import QUERIES, vectors

    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(4)[i % 4] + 0.1 * rng.normal(size=4)).tolist(), i % 4) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [len(x) for x in (vectors.STABILITY_NEIGHBOURS, vectors.STABILITY_RESOLUTIONS, vectors.STABILITY_SEEDS)] == [3, 3, 3]
    got = QUERIES["stability_grid"](spark, str(tmp_path)).collect()
    assert {(r["run_a"], r["run_b"]) for r in got} == {(a, b) for a in range(27) for b in range(a + 1, 27)}
    assert all(r["ari"] <= 1 and r["ami"] <= 1 for r in got) and sum(r["ari"] > 0.9 for r in got) > 100


def test_linkage_and_density():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in ((1, 0), (0, 1), (-1, -1))])
    truth = np.repeat([0, 1, 2], 30)
    for found in (cluster.average_linkage(v, 3), cluster.hdbscan_labels(v, 8)):
        for c in range(3):
            inside = found[truth == c]
            assert np.bincount(inside + 1).max() >= 25
    assert cluster.hdbscan_labels(v[:1], 5).tolist() == [-1]


def test_valid_runs_fall_back(spark):
    df = spark.createDataFrame([(1, "10", "0.1", "0", None), (2, "x", "0.1", "0", None)], "run_id long, cluster_count string, largest_cluster_share string, noise_share string, error string")
    assert [r["run_id"] for r in select.valid_runs(df).collect()] == [1]
    assert select.valid_runs(df.where("run_id = 2")).count() == 1
    with pytest.raises(LookupError):
        select.first_row(df, "run_id", run_id=9)


def test_split_shares(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("s"))
    n = {(r["s"], r["split"]): r["count"] for r in learn.stratified_split(rows, "s", 1).groupBy("s", "split").count().collect()}
    assert sum(n.values()) == 1000
    for s in range(3):
        assert n[s, "train"] / 334 == pytest.approx(0.7, abs=0.01)


def test_projection_learns():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(400, 8)), rng.normal(size=(400, 8))
    y = (a[:, 0] * b[:, 0] > 0).astype(float)
    _, losses = learn.train_projection(a, b, y, 4, epochs=15, rate=1e-2)
    assert losses[-1] < losses[0]


PAGE = """<div class="topicbox" data-id="7" data-t="j"><p class="title">12.03.2004 x</p><div class="text">One<br>two <b>three</b></div>
<div class="tags"><a href="/tags/a">A</a><a href="/tags/a">A</a></div><a class="auth" href="/u/1">Ann</a><span class="num">+5</span></div>
<div class="topicbox" data-t="x"><div class="text">no</div><div class="tags"><a href="/tags/b">B</a></div></div><div class="topicbox"><div class="text">no tags</div></div>"""


def test_boxes_become_records(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>broken <a")], "page_id long, html string")
    blocks = html.blocks(pages)
    assert blocks.count() == 3
    got = html.records(blocks, 2004, 3, "https://h.example").collect()
    assert [(r["id"], r["date"], r["text"], r["rating"], r["tags_raw"], r["author_url"]) for r in got] == [("7", "2004-03-12", "One two three", 5, ["A"], "https://h.example/u/1")]
    assert html.links(pages).count() == 3 + 1


def test_months_roll_over(spark):
    got = [(r["year"], r["month"]) for r in corpus.months(spark, (1999, 11), (2000, 2)).orderBy("year", "month").collect()]
    assert got == [(1999, 11), (1999, 12), (2000, 1), (2000, 2)]


def test_files(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert config.read_manifest(path) is None
    config.write_manifest(path, {"model_id": "m", "dataset_row_count": 3})
    assert config.manifest_matches(path, {"model_id": "m", "dataset_row_count": 3}) and not config.manifest_matches(path, {"model_id": "n", "dataset_row_count": 3})
    (tmp_path / "m.json").write_text("{")
    assert not config.manifest_matches(path, {})
    df = spark.createDataFrame([(1, 'a "quoted", text\nline', ["x", "é"])], "id long, text string, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert tables.csv(spark, str(tmp_path / "c"), "id long, text string, tags string").collect() == [(1, 'a "quoted", text\nline', '["x","é"]')]
    df.write.parquet(str(tmp_path / "t"))
    first = sinks.replace_table(spark, str(tmp_path / "t"), lambda d: d.withColumn("id", F.col("id") + 1))
    assert spark.read.parquet(first).first()["id"] == 2 and spark.read.parquet(str(tmp_path / "t")).first()["id"] == 1
    assert tables.optional(spark, str(tmp_path / "none"), "a int").count() == 0
    assert tables.missing(spark, [str(tmp_path / "t"), str(tmp_path / "none")]) == [str(tmp_path / "none")]
    configs = spark.createDataFrame([(1,), (2,)], "config_id long")
    run = lambda c: c.withColumn("score", F.lit(1.0))
    assert sinks.write_runs(run, configs.where("config_id = 1"), str(tmp_path / "r")).count() == 1
    assert sinks.write_runs(run, configs, str(tmp_path / "r")).count() == 2
    assert "| 1 |" in sinks.markdown("t", [("h", df.select("id"), 5)])


def test_rolling_checksum(spark):
    import hashlib

    rows = spark.createDataFrame([(2, "b"), (1, "a")], "ord long, h string")
    assert corpus.rolling_checksum(rows, "h", "ord") == hashlib.sha256(b"a\nb\n").hexdigest()


def test_streams(spark, tmp_path):
    from corvane.streaming import incremental

    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0, "Text"), ("2024-01-01 01:00:00", "a", 2.0, " text"), ("2024-01-03 00:00:00", "b", 3.0, "other")], "ts string, event_type string, value double, text string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, text string").parquet(str(tmp_path / "in"))
    incremental.write_stream(incremental.dedup_stream(stream, "ts", "10 days"), str(tmp_path / "d"), str(tmp_path / "cd")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    incremental.write_stream(incremental.coverage_stream(stream, "ts", "1 day", "1 hour"), str(tmp_path / "w"), str(tmp_path / "cw")).awaitTermination()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "w")).collect()] == [2]
