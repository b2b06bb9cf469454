"""Each operator against SQL, the library it follows, or a brute-force version, and over odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from corvane.llm import crf_language, decontaminate, line_templates, order_minhash, pieces, repair, sharding, sketch, url_rules, warc
from corvane.llm.registry import ORACLE_SQL, QUERIES
from tests.comparing import assert_same
from tests.conftest import SMALL

from .conftest import LONG, ODD


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, SMALL).toPandas()
        return made[name]

    return get


@pytest.fixture(scope="module")
def docs(small):
    return [(r["doc_id"], r["text"], r["lang"]) for r in small.orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(results, duck, name):
    assert_same(results(name), duck.execute(ORACLE_SQL[name]).df())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# 1 language


def test_languages_of_held_out_documents(results, docs):
    got = results("op1_crf_language").set_index("doc_id")
    truth = {i: lang for i, _, lang in docs}
    for i in truth:
        assert got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    out = got[got["held_out"]]
    assert np.mean([truth[i] == p for i, p in out["lang_pred"].items()]) >= 0.95
    assert out["score"].between(0, 1).all()


def test_code_switching_is_labelled_word_by_word(docs):
    crf = crf_language.train([(t, lang) for _, t, lang in docs])
    de, fr = (next(crf_language.tokenize(t)[:40] for _, t, lang in docs if lang == x and len(crf_language.tokenize(t)) > 60) for x in ("de", "fr"))
    lang, score, runs = crf_language.Labeller(crf).label([" ".join(de + fr)])[0]
    assert runs[0][0] == "de" and runs[-1][0] == "fr" and abs(runs[0][1] - 40) <= 3 and sum(n for _, n in runs) == 80
    assert score < 0.7


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[0, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            want[i, y] += w
    got = crf_language.forward_backward(e, np.ones((1, 4), bool), t)[0][0]
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_a_long_text_is_one_chain(docs, monkeypatch):
    crf = crf_language.train([(t, lang) for _, t, lang in docs])
    texts = [crf_language.tokenize(" ".join(t for _, t, _ in docs[i : i + 3])) for i in range(0, 24, 3)] + [[], ["x"], ["y"] * 33]
    emit = [crf.scores(t)[None].astype(np.float64) for t in texts]
    want = [crf_language.forward_backward(e, np.ones(e.shape[:2], bool), crf.transitions)[0][0] if e.shape[1] else e[0] for e in emit]
    for run in (7, 32, 1024):
        monkeypatch.setattr(crf_language, "RUN_WORDS", run)
        got = crf_language.Labeller(crf).posteriors(texts)
        assert all(np.allclose(g, w, atol=1e-9) for g, w in zip(got, want, strict=True))


def test_numbers_are_no_letters(docs):
    crf = crf_language.train([(t, lang) for _, t, lang in docs])
    assert crf_language.tokenize("½ ② x² é 漢 Ⅷ 7b_c") == ["x", "é", "漢", "b", "c"]
    assert [x[:2] for x in crf_language.Labeller(crf).label(["½ ②", "²", "_ 7", ""])] == [("und", 0.0)] * 4


def test_long_labelled_texts_are_learned_from(spark, docs, monkeypatch):
    monkeypatch.setattr(crf_language, "TRAIN_CHARS", 600)
    long = [(i, " ".join(t for _, t, x in docs if x == lang)[:30_000], lang) for i, lang in enumerate(("de", "fr"), 1)]
    rows = [(10 * k + i, t, lang) for i, t, lang in long for k in range(5)]
    assert crf_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).labels == ["de", "fr"]


def test_language_of_odd_rows(odd, none, small):
    crf = crf_language.fit(small)
    got = {(r["doc_id"], r["size"]): r for r in crf_language.label_documents(odd, crf).collect()}
    for i in (0, 1, 5):
        assert (got[i, "own"]["lang_pred"], got[i, "own"]["score"]) == ("und", 0.0)
    assert got[6, "own"]["lang_pred"] in crf.labels
    assert crf_language.label_documents(none, crf).count() == 0
    assert crf_language.fit(none).labels == []
    assert {r["lang_pred"] for r in crf_language.label_documents(odd, crf_language.fit(none)).collect()} == {"und"}
    kept = crf_language.stage(small)
    assert kept.columns == small.columns and kept.count() == small.count()


# 2 shards


def shards_by_hand(rows, shards):
    order = sorted((zlib.crc32((t or "").encode()), -(1 << 62) if i is None else i, len((t or "").encode()) + 1) for i, t in rows)
    return order, sum(x[2] for x in order) / shards


def check_shards(got, rows, shards):
    order, share = shards_by_hand(rows, shards)
    most = max(x[2] for x in order)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["text_crc32"], -(1 << 62) if r["doc_id"] is None else r["doc_id"], r["size"]))
    flat = []
    for s in sorted(by):
        part = sorted(by[s])
        assert [p[0] for p in part] == list(range(len(part)))
        flat += [p[1:] for p in part]
        assert abs(sum(p[3] for p in part) - share) <= most + 0.01 * share
    assert flat == order


def test_shards_are_even_and_in_order(results, docs):
    got = results("op2_histogram_sort").to_dict("records")
    check_shards(got, [(i, t) for i, t, _ in docs], 16)
    assert {r["law"] for r in got} == {"bytes"}


def test_shards_split_a_hot_text(spark):
    rows = [(i, "hot" if i % 2 else f"text {i}") for i in range(600)]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), 4, 2).collect()
    check_shards(got, rows, 4)


def test_many_ranges_are_searched_in_arrays(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TREE_STARTS", 3)
    monkeypatch.setattr(sharding, "PIECE_BYTES", 500)
    rows = [(i, "hot" if i % 2 else f"text {i}" * 9) for i in range(600)]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check_shards(got, rows, 4)


def test_shards_of_odd_rows(odd, none):
    got = sharding.histogram_sort(odd, 2, 2)
    assert set(odd.columns) <= set(got.columns)
    assert sorted(r["size"] for r in got.collect()) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in ODD)
    assert sharding.histogram_sort(none).count() == 0


# 3 WARC


def test_warc_records_link_and_hold_their_digests(spark, results):
    import base64

    got = results("op3_warc_derivatives")
    for r in got.head(40).to_dict("records"):
        block = r["block"].encode()
        assert r["content_length"] == len(block)
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    for _, pair in got.groupby("page_id"):
        assert set(pair["record_type"]) == {"metadata", "conversion"} and pair["refers_to"].nunique() == 1
        conversion = pair[pair["record_type"] == "conversion"]["record_id"].iloc[0]
        assert f"conversion: {conversion}" in pair[pair["record_type"] == "metadata"]["block"].iloc[0]


def test_warc_of_odd_pages(spark):
    rows = [
        (1, None, None, "own"),
        (2, "http://h.example/a", "", "own"),
        (3, "http://h.example/a?x", '<title>T &amp; t</title><p>a&eacute;&#x4e2d;<br>b <script>var x="<p>";</script><!-- no --><a href="/l">c</a></p>', "own"),
        (3, "http://h.example/a?x", "x" * 200_000, "own"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.serialize(warc.derivatives(warc.responses(pages))).collect()
    assert Counter((r["page_id"], r["record_type"]) for r in got) == {(1, "metadata"): 1, (2, "metadata"): 1, (2, "conversion"): 1, (3, "metadata"): 2, (3, "conversion"): 2}
    text = next(r["block"] for r in got if r["page_id"] == 3 and r["record_type"] == "conversion" and len(r["block"]) < 100)
    assert text == "T & t\naé中\nb c"
    meta = next(r for r in got if r["page_id"] == 3 and r["record_type"] == "metadata" and "outlink" in r["block"])
    assert "outlink: http://h.example/l\r\n" in meta["block"] and "source-header: Content-Type: text/html; charset=utf-8" in meta["block"]
    assert meta["record"].startswith("WARC/1.1\r\nWARC-Type: metadata\r\n") and meta["record"].endswith("\r\n\r\n")
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0
    other = warc.responses(pages).withColumn("headers", F.lit("Content-Type: image/png")).withColumn("mine", F.lit(1))
    assert {r["record_type"] for r in warc.derivatives(other).collect()} == {"metadata"}


def test_warc_fields_are_lines_of_their_own(spark):
    kind = "record_id string, target_uri string, warc_date string, status string, headers string, body string"
    rows = [(None, "http://h/\nWARC-Type: x", "d", None, "Content-Type: text/html\r\nA: b\nsource-status: y", "<p>a"), ("<urn:uuid:1>", "http://h/", "d", "s", None, "x"), (None, None, None, None, None, None)]
    got = warc.serialize(warc.derivatives(spark.createDataFrame(rows, kind))).collect()
    assert len(got) == 4 and len({r["record_id"] for r in got}) == 4 and all(len(r["record_id"]) == 47 for r in got)
    for r in got:
        head, _, block = r["record"].partition("\r\n\r\n")
        assert sum(x.startswith("WARC-Type:") for x in head.split("\r\n")) == 1 and "\n" not in head.replace("\r\n", "")
        assert f"WARC-Source-Payload-Digest: {r['source_payload_digest']}" in head and f"WARC-Refers-To: {r['refers_to']}" in head
        if r["record_type"] == "metadata":
            assert sum(x.startswith("source-status:") for x in block.split("\r\n")) == 1 and "\n" not in block.replace("\r\n", "")


# 4 URLs


def rule_by_hand(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c < "\x80" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, h, p in url_rules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def mined_by_hand_holds(mined, known):
    assert mined
    for ante, confidence, support in mined:
        n, hits = sum(ante <= t for t, _ in known), sum(ante <= t and b for t, b in known)
        assert confidence == pytest.approx(hits / n) and support == pytest.approx(hits / len(known)) and hits >= url_rules.MIN_COUNT
        assert not any(a < ante and c >= confidence and len(ante) - len(a) == 1 for a, c, _ in mined)


def test_url_rules_and_mined_rules(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables have too few labelled pages for a rule
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    tokens = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    fixed = {i: rule_by_hand(u) for i, u in urls.items()}
    bad = {i: f[2][1] == "block" for i, f in fixed.items() if f[2]}
    labelled = spark.createDataFrame([(urls[i], b) for i, b in bad.items()], "url string, blocked boolean")
    mined = [(frozenset(r["antecedent"]), r["confidence"], r["support"]) for r in url_rules.mine(labelled).collect()]
    mined_by_hand_holds(mined, [(tokens[i], b) for i, b in bad.items()])
    for r in (r.asDict() for r in QUERIES["op4_association_rules"](spark, folder).collect()):
        host, path, rule = fixed[r["page_id"]]
        assert (r["host"], r["path"]) == (host, path)
        fires = any(a <= tokens[r["page_id"]] for a, _, _ in mined)
        assert (r["rule"], r["verdict"]) == (rule if rule else (None, "block" if fires else "allow"))


def test_held_out_verdicts_are_recovered(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = [(r["url"], rule_by_hand(r["url"])[2]) for r in pages.collect()]
    rows = [(u, rule[1] == "block") for u, rule in rows if rule]
    known, rest = (spark.createDataFrame([x for x in rows if (zlib.crc32(x[0].encode()) % 5 == 0) == held], "url string, blocked boolean") for held in (False, True))
    hit = {r["url"] for r in url_rules.match(rest, url_rules.mine(known)).collect()}
    truth = {r["url"]: r["blocked"] for r in rest.collect()}
    assert sum(truth.values()) >= 10 and np.mean([(u in hit) == b for u, b in truth.items()]) >= 0.9
    assert np.mean([u in hit for u, b in truth.items() if b]) >= 0.9


def test_tokens_that_say_the_same_count_once(spark):
    rows = [(f"http://a.b.c.d.e.f.example.org/x/y/z/u/v/w?k={i % 2}&m=1&o=2&p=3#q", i % 2 == 0) for i in range(40)] + [(f"https://other{i}.org/x", False) for i in range(40)]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert [(sorted(r["antecedent"]), r["confidence"]) for r in mined] == [(["query=k=0"], 1.0)]
    assert url_rules.mine(spark.createDataFrame([(None, None), ("x", True)], "url string, blocked boolean")).count() == 0


def test_urls_of_odd_rows(spark):
    rows = [(None, None, "own"), (1, "", "own"), (2, "no scheme/x", "own"), (3, "HTTP://WWW.Example.COM/en/x?a=b&c#d", "own"), (3, "HTTP://WWW.Example.COM/en/x?a=b&c#d", "own"), (4, "http://a.net/es/" + "x" * 50_000, "own"), (5, "http://com", "own"), (6, "a://b://com/", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    labelled = spark.createDataFrame([(None, True), ("http://a.net/es/", None), ("http://b.org/x", True)], "url string, blocked boolean")
    for judged in (url_rules.judge(pages), url_rules.judge(pages, labelled), url_rules.judge(pages, labelled.where("false"))):
        got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in judged.collect()]
        assert Counter(got) == Counter([(None, "", None, "allow"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "www.example.com", "www.example.com/en/", "allow"), (3, "www.example.com", "www.example.com/en/", "allow"), (4, "a.net", "net/es/", "block"), (5, "com", None, "allow"), (6, "b:", None, "allow")])
    assert url_rules.judge(pages.where("false"), labelled).count() == 0


def test_of_rules_equally_sure_the_better_supported_fires(spark):
    rows = [("http://x.org/a/b", True)] * 20 + [("http://x.org/a/c", True)] * 10 + [("http://y.org/c", False)] * 20 + [("http://y.org/d/c", True)] * 6
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://x.org/a/c")], "page_id long, url string")
    got = url_rules.judge(pages, labelled).first()
    best = max((r["support"] for r in url_rules.mine(labelled).collect() if r["confidence"] == 1.0))
    assert got["verdict"] == "block" and got["confidence"] == 1.0 and best == pytest.approx(30 / 56)


# 5 lines


def test_lines_generalise_and_first_stays(spark):
    boiler = [f"report {i} of the day {i * 7} was sent by {n} to all who wanted it and asked" for i, n in enumerate(["ann", "bob", "cid"])]
    own = [f"this {w} line stands in one place only and says {w}" for w in ("red", "blue", "green")]
    rows = [(i, f"{own[i]}\n{boiler[i]}\nshort line") for i in range(3)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_dropped"] for i in range(3)] == [0, 1, 1]
    assert got[1]["clean_text"] == f"{own[1]}\nshort line"


def test_short_lines_recur_from_more_texts_on(spark):
    own = lambda i: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(6))
    rows = [(i, f"{own(i)}\nRead more\n{i}\n\n" + ("Rare line" if i < 9 else "-")) for i in range(12)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["clean_text"] == rows[0][1]
    for i in range(1, 12):
        assert got[i]["clean_text"] == rows[i][1].replace("Read more\n", "")


def test_variants_within_one_text_count_once(spark):
    variants = "\n".join(f"this is the very same sentence about {w} things" for w in ("red", "blue", "green"))
    rows = [(0, variants), (1, "this is the very same sentence about pink things"), (2, "a text that has nothing to do with the others here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_dropped"] for r in line_templates.drop_recurring(docs).collect()} == {0}
    more = docs.unionByName(spark.createDataFrame([(3, "this is the very same sentence about grey things")], docs.schema))
    assert {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring(more).collect()} == {0: 2, 1: 1, 2: 0, 3: 1}


def test_long_passages_go_from_all_but_the_first(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(60))
    rows = [(i, f"an own beginning of number {chr(97 + i) * 3}\n{passage}") for i in range(8)] + [(9, "a clean text that nothing else repeats anywhere")]
    got = {r["doc_id"]: r["clean_text"] for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [passage in got[i] for i in range(8)] == [True] + [False] * 7
    assert got[9] == rows[-1][1]


def test_lines_of_odd_rows(odd, none):
    got = line_templates.drop_recurring(odd)
    rows = got.collect()
    assert len(rows) == len(ODD) and set(odd.columns) <= set(got.columns)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["clean_text"]) for r in rows if r["text"]) == sorted((i is None, i, t) for i, t, _, _ in ODD if t)
    assert line_templates.drop_recurring(none).count() == 0 and line_templates.stage(none).count() == 0
    assert line_templates.stage(odd).columns == odd.columns


# 6 sketches


def sketch_by_hand(text):
    w = words(text)
    if not w:
        return []
    if len(w) < 5:
        return [hashed(" ".join(w), 42)]
    every = set()
    for i in range(len(w) - 4):
        seed = 42
        for x in w[i : i + 5]:
            seed = hashed(x, seed)
        every.add(seed)
    return sorted(h for h in every if h < (1 << 62) - (1 << 63)) or [min(every)]


def hashed(text, seed):
    h = xxhash.xxh64_intdigest(text.encode(), seed & (1 << 64) - 1)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_fingerprints_by_hand(results, docs):
    got = results("op6_scaled_sketch").set_index("doc_id")
    texts = [t or "" for _, t, _ in docs]
    spell = lambda s: "".join(f"{h & (1 << 64) - 1:016X}" for h in s)

    def like(a, b):
        return 1.0 if not a and not b else 0.0 if not a or not b else len({*a} & {*b}) / min(len(a), len(b))

    for k, (i, t, _) in enumerate(docs):
        nxt = texts[(k + 1) % len(texts)]
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, b = map(sketch_by_hand, (t, edited, nxt))
        r = got.loc[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (spell(a), spell(e))
        assert r["near_edited"] == pytest.approx(like(a, e)) and r["near_next"] == pytest.approx(like(a, b))


def test_sketches_merge_and_contain(spark, odd, none):
    halves = odd.where("doc_id = 6").select(*(sketch.sketch(F.expr(e)).alias(n) for e, n in (("text", "w"), ("substring(text, 1, 200000)", "a"), ("substring(text, 190000)", "b"))))
    r = halves.select(sketch.containment(F.col("a"), F.col("w")).alias("c"), F.size(F.array_except(sketch.merge(F.col("a"), F.col("b")), "w")).alias("more")).first()
    assert r["c"] > 0.99 and r["more"] <= 3
    assert [x["s"] for x in odd.where("doc_id IN (0, 1, 5)").select(sketch.sketch(F.col("source")).alias("s"), sketch.sketch(F.col("text")).alias("t")).collect()][0] == []
    near = sketch.with_next(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], buckets=3)
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t, _, _ in ODD))
    want = Counter((a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r["text"], r["next_text"]) for r in near.collect()) == want
    assert sketch.with_next(none.select("doc_id", "text"), "doc_id", ["text"]).count() == 0


# 7 pieces


def test_pieces_are_the_librarys(results, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    got = results("op7_distinct_chunks").set_index("doc_id")
    for i, t, _ in docs:
        ids = model.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got.loc[i]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_pieces_of_random_texts():
    rng = random.Random(4)
    table = pieces.PieceTable(public_tokenizers.path(pieces.MODEL))
    parts = [" ", "  ", "a", "the", "\n", "\t", "\u00a0", "é", "漢", "😀", "▁", "1", ".", "<s>", "\u2028", "\x00", "ﬁ", "b" * 300]
    texts = [None, "", " ", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000))]
    for t, (ids, n, back) in zip(texts, table.encode(texts), strict=True):
        want = table.model.encode(t or "")
        assert (ids, n, back) == (",".join(map(str, want)), len(want), table.model.decode(want))


def test_pieces_of_odd_rows(odd, none):
    got = pieces.encode_documents(odd).collect()
    assert len(got) == len(ODD) and got[0]["shard"] == "own"
    by = {r["doc_id"]: r for r in got}
    assert by[0]["ids"] == by[1]["ids"] == [] and by[6]["decoded"] == LONG and by[6]["n_tokens"] == len(by[6]["ids"])
    assert pieces.encode_documents(none).count() == 0


# 8 files


def test_ids_come_back_from_the_files(results, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(repair.TOKENIZER))
    got, start = results("op8_re_pair").set_index("doc_id"), 0
    for i, t, _ in docs:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(got.loc[i]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_re_pair_round_trips_and_reads_at_random():
    rng = np.random.default_rng(3)
    docs_ = [rng.integers(0, 5, n).astype(np.uint32) for n in (0, 1, 2, 700, 3, 0, 900, 1)] + [np.zeros(50, np.uint32)]
    shard = repair.Shard.read(repair.write_shard([*range(8), None], docs_, 5, frequent=2, rounds=12))
    assert len(shard.rules) > 10 and len(shard.symbols) < sum(map(len, docs_)) / 2
    for i, d in enumerate(docs_):
        assert shard.document(i).tolist() == d.tolist()
    flat = np.concatenate(docs_)
    for _ in range(50):
        a = int(rng.integers(0, len(flat)))
        b = int(rng.integers(a, len(flat) + 1))
        assert shard.span(a, b).tolist() == flat[a:b].tolist()
    least = repair.Shard.read(repair.write_shard([None, -(1 << 63), 0], docs_[3:6], 5)).doc_ids
    assert least == [None, -(1 << 63), 0]
    assert repair.Shard.read(repair.write_shard([], [], 5)).expand(np.empty(0, np.uint32)).tolist() == []
    with pytest.raises(ValueError, match="not a shard"):
        repair.Shard.read(b"x" * 64)


def test_re_pair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 9, 3000), np.tile(rng.integers(0, 9, 70), 40), np.full(999, 4)]).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[[50, 51, 4000, len(ids) - 1]] = True
    symbols, ends, rules = repair.compress(ids, last, 9, frequent=4)
    pairs = Counter((int(a), int(b)) for a, b, z in zip(symbols, symbols[1:], ends, strict=False) if not z)
    # of a run of one symbol only every other pair can be replaced
    assert all(n < 4 or a == b for (a, b), n in pairs.items()) and len(rules) > 100
    shard = repair.Shard.read(repair.write_shard([0], [ids], 9, frequent=4))
    assert shard.document(0).tolist() == ids.tolist()


def test_chunks_encode_as_the_library():
    rng = random.Random(4)
    table = repair.ChunkTable(public_tokenizers.path(repair.TOKENIZER))
    parts = [" ", "  ", "a", "the", "\n", "\t", "\u00a0", "é", "漢", "😀", "\x01", "1", ".", "'s", "<|endoftext|>", "\r\n", "ﬁ", "b" * 300]
    parts += ["\u3000", "\x85", "\x1f", "word,", "naïve", "’tis", "don't", "½", "ǅ", "中文" * 90]
    texts = [None, "", " ", "a ", "\n", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000))]
    table.table.most = 500  # entries have to go now and then
    found = [ids for k in range(0, len(texts), 100) for ids in table.encode(texts[k : k + 100])]
    for t, ids in zip(texts, found, strict=True):
        assert ids.tolist() == table.model.encode(t or "", add_special_tokens=False).ids


def test_files_of_odd_rows(spark, odd, none, tmp_path):
    repair.write_ids(odd, str(tmp_path / "a"), shard_ids=1000)
    got = repair.read_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 2, 3, 5, 6, 7, 8]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert got[1]["ids"] == got[2]["ids"] == [0]
    repair.write_ids(none, str(tmp_path / "b"))
    assert repair.read_ids(spark, str(tmp_path / "b")).count() == 0


# 9 benchmark


def test_decontamination_of_odd_rows(spark, odd, none):
    a = ODD[2][1]
    items = spark.createDataFrame([("i1", a), ("i1", a), ("i2", "seven eight"), (None, "without an id"), ("i3", None), ("i4", "..."), ("i5", " ".join(LONG.split()[500:520]))], "item_id string, text string")
    got = {(r["doc_id"]): r for r in decontaminate.decontaminate(odd, items).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["contaminated"]) == (0, 0, False)
    assert got[2]["n_hit"] == got[3]["n_hit"] == 15 and got[2]["item_ids"] == ["i1", "i2"] and got[2]["contaminated"]
    assert got[None]["item_ids"] == ["null"] and got[None]["n_hit"] == 3
    assert "i5" in got[6]["item_ids"] and not got[6]["contaminated"]
    assert decontaminate.decontaminate(odd, items).count() == len(ODD)
    assert decontaminate.decontaminate(none, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(odd, items.where("false")).collect()} == {0}
    kept = decontaminate.stage(odd, items)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "5", "7", "8"]


def test_every_long_shared_span_is_found(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(60):
        n, at = rng.randrange(10, 20), rng.randrange(0, 20)
        rows.append((i, " ".join([rng.choice(vocabulary) for _ in range(30)] + item[at : at + n] + [rng.choice(vocabulary) for _ in range(30)])))
    windows = {tuple(item[j : j + 13]) for j in range(28)}
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("x", " ".join(item))], "item_id string, text string")).collect()}
    for i, t in rows:
        w = t.split()
        hit = {p for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for p in range(j, j + 13)}
        assert got[i] == len(hit)


def test_one_window_of_an_item_drops_a_document_of_any_length(spark):
    item = " ".join(f"bench{i}" for i in range(15))
    own = " ".join(f"Own{i}é," for i in range(400))
    rows = [(1, f"{own}\n({item.replace(' ', ', ').upper()})\n{own}", 7), (2, f"{own}\n{item[:100]}", 7), (3, own, 7), (4, item, 7), (5, None, None), (6, f"{own} two words", 7), (7, "only two words", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([("i", item), ("j", "two words")], "item_id string, text string")
    assert sorted(decontaminate.stage(docs, items).collect()) == [docs.where("doc_id = 3").first(), docs.where("doc_id = 5").first(), docs.where("doc_id = 6").first()]
    assert decontaminate.stage(docs, items.where("false")).count() == len(rows)


# 10 near duplicates


def classes_by_hand(rows):
    kmers = [order_minhash.labelled_kmers(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or order_minhash.aligned_similarity(kmers[i], kmers[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: low[find(i)] for i in range(len(rows))}


def near_rows():
    rng = random.Random(6)
    rows, n = [], 0
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(1 + g):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            rows.append((n, " ".join(w)))
            n += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(30):
        rows.append((n, f"{' '.join(f'o{rng.randrange(9999)}' for _ in range(70))} {passage}"))
        n += 1
    return rows


def test_near_duplicates_against_all_pairs(spark, results, docs):
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows)
    found = results("op10_order_minhash").set_index("doc_id")["class_id"].to_dict()
    assert found == classes_by_hand([(i, t) for i, t, _ in docs])


def edited_copies(n, seed=1):
    """Copies of a base that is not among them, each with 3 to 6 of its 200 words changed."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(3, 6)):
            w[at] = f"e{rng.randrange(10**9)}"
        yield i, " ".join(w)


@pytest.mark.parametrize(("block_words", "hot", "pairs"), [(1 << 20, 10_000, 256), (5000, 20, 7)])
def test_members_unlike_the_head_find_each_other(spark, monkeypatch, block_words, hot, pairs):
    monkeypatch.setattr(order_minhash, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(order_minhash, "HOT", hot)
    monkeypatch.setattr(order_minhash, "PAIRS_A_PART", pairs)
    rows = list(edited_copies(500))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows)


def test_alignment_counts_the_longest_chain():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate((a[50:], a[:50]))
    assert order_minhash.aligned_similarity(a, a) == 1.0
    assert order_minhash.aligned_similarity(a, b) == 0.0
    c = np.delete(a, [10, 20])
    assert order_minhash.aligned_similarity(a, c) == pytest.approx(0.98)
    c = a.copy()
    c[[3, 4]] = c[[4, 3]]
    assert order_minhash.aligned_similarity(a, c) == pytest.approx(99 / 101)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = order_minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["class_id"])
    assert by[0] == by[1] == {0} and by[2] == by[3] == {2} and by[6] == {6} and min(by[None]) >= 1 << 62
    kept = order_minhash.stage(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "2", "5", "6", "7", "8", "None"]
    assert order_minhash.near_duplicates(none).count() == 0 and order_minhash.stage(none).count() == 0
