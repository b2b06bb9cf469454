"""Order MinHash near-duplicates.

A text's k-mers are its five-word shingles, each labelled by which occurrence it is. Each of ``SKETCHES`` hash functions takes
the ``TAKE`` smallest labelled k-mers, and the sketch entry hashes them in text order, so that moved passages
change it. Texts that share an entry meet in a bucket. First a bucket compares its members with the one that meets the most others (a
star). Then buckets whose members are in several components compare all pairs of members that are not connected yet: common k-mers are
counted for all pairs at once, and those with enough of them are verified. No bucket is capped, so all links between texts
that share an entry are found, or the texts are connected without them. Verification aligns the labelled k-mers within the band that
the threshold allows: similarity is aligned / (a + b - aligned), where ``aligned`` is the longest chain of common
labelled k-mers that ascends in both texts.

Equal texts are one node from the start. Links are joined to classes by alternating large-star and
small-star steps; a class's id is its lowest doc_id.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, maybe_broadcast, releasing, table

SHINGLE = 5
SKETCHES = 16
TAKE = 2
BLOCK_WORDS = 1 << 20  # k-mers of a bucket that one task holds; larger buckets are dealt over tasks
SIMILAR = 0.8
PAIRS_A_PART = 256  # pairs that share one copy of their head's text
HOT, HOT_BUCKETS = 10_000, 50_000  # members from which on a bucket is not shuffled by its name, and how many such buckets there can be
PAIRS_AT_ONCE = 128

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20_240_229)
_SEEDS = _RANDOM.integers(0, 1 << 64, SKETCHES, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for i, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_kmers(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of (k-mer, occurrence), in text order; a text of 1 to k - 1 words is one k-mer."""
    even = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    if not even:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(even, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    if len(starts) > k:
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    elif len(starts) <= k:
        starts, ends = starts[:1], ends[-1:]
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = _mix((total[ends] - total[starts]) * down[starts])
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    label = np.empty(len(h), np.uint64)
    label[order] = (np.arange(len(h)) - first).astype(np.uint64)
    return np.where(label == 0, h, _mix(h + label * np.uint64(_BASE)))


def sketch(h: np.ndarray) -> np.ndarray:
    """One entry for each hash function: its smallest labelled k-mers, in text order."""
    out = np.empty(SKETCHES, np.uint64)
    if not len(h):
        return out[:0]
    for j in range(SKETCHES):
        x = (h ^ _SEEDS[j]) * _ODD[j]
        at = [int(x.argmin())]
        for _ in range(min(TAKE, len(h)) - 1):
            x[at[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            at.append(int(x.argmin()))
        value = np.uint64(j + 1)
        for i in sorted(at):
            value = _mix((value * np.uint64(_BASE) ^ h[i])[None])[0]
        out[j] = value
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned labelled k-mers over all, within the band that ``least`` allows; 0.0 as soon as it can't be reached."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < least * (na + nb - len(ia)):
        return 0.0
    band = int((na + nb) * (1 - least) / (1 + least)) + 1
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    chain = ib[np.argsort(ia)]
    m = len(chain)
    if m > 1 and not (np.diff(chain) > 0).all():
        tails: list[int] = []
        for v in chain.tolist():
            at = bisect_left(tails, v)
            tails[at : at + 1] = [v]
        m = len(tails)
    s = m / (na + nb - m) if m else 0.0
    return s if s >= least else 0.0


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in batches:
        keys, rows, n = [], [], []
        for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
            for text in batch.slice(at, PAIRS_AT_ONCE).column("text").to_pylist():
                keys.append(hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest())
                kmers = labelled_kmers(text)
                n.append(len(kmers))
                rows.append(sketch(kmers).view(np.int64))
        offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["doc_id", "key", "len", "sketch"],
        )


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on rows in the order of head, part and guest: the head's own row, then its members'."""
    np.seterr(over="ignore")
    at, head = None, np.empty(0, np.uint64)
    for batch in batches:
        heads: list[bytes] = []
        keys: list[bytes] = []
        near: list[bool] = []
        for start in range(0, batch.num_rows, PAIRS_AT_ONCE):
            few = batch.slice(start, PAIRS_AT_ONCE)
            for a, part, guest, key, text in zip(*(few.column(c).to_pylist() for c in ("a", "part", "guest", "key", "text")), strict=True):
                if not guest:
                    at, head = (a, part), labelled_kmers(text)
                elif at == (a, part):
                    heads.append(a)
                    keys.append(key)
                    near.append(aligned_similarity(head, labelled_kmers(text)) >= SIMILAR)
                else:
                    raise RuntimeError("a member came without its head")
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(keys, pa.binary()), pa.array(near, pa.bool_())], ["a", "b", "near"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, near) of pairs (a, b, la, lb); those whose lengths rule out the similarity are decided without their texts.

    A head's members are dealt to parts of about ``PAIRS_A_PART``, and each part gets the head's text once.
    """
    pairs = checkpoint(pairs)
    possible = F.least("la", "lb") >= SIMILAR * F.greatest("la", "lb")
    asked = pairs.where(possible).select("a", "b")
    parts = checkpoint(asked.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_PART).cast("int").alias("parts")).where("parts > 1"))
    asked = asked.join(maybe_broadcast(parts), "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)))
    asked = checkpoint(asked.select("a", "b", "part"))
    heads = asked.select("a", "part").distinct().select("a", "part", F.lit(False).alias("guest"), F.col("a").alias("key"))
    rows = heads.unionByName(asked.select("a", "part", F.lit(True).alias("guest"), F.col("b").alias("key"))).join(texts, "key")
    rows = rows.select("a", "part", "guest", "key", "text").repartition("a", "part").sortWithinPartitions("a", "part", "guest")
    near = rows.mapInArrow(releasing(_verify_batches), "a binary, b binary, near boolean")
    return checkpoint(near.unionByName(pairs.where(~possible).select("a", "b", F.lit(False).alias("near"))))


def _beside(rows: DataFrame, facts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with one row of ``facts`` a bucket: those of hot buckets by a broadcast, so that no task gets a hot bucket whole."""
    if hot is None:
        return rows.join(facts, "bucket")
    large = rows.join(hot, "bucket", "left_semi").join(facts.join(hot, "bucket", "left_semi").transform(F.broadcast), "bucket")
    return large.unionByName(rows.join(hot, "bucket", "left_anti").join(facts.join(hot, "bucket", "left_anti"), "bucket"))


def _stars(members: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Members of buckets with the bucket's head (the best connected member) and its size."""
    heads = checkpoint(members.groupBy("bucket").agg(F.max(F.struct("ties", "key", "len")).alias("head"), F.count("*").alias("n")))
    return _beside(members, heads, hot).select("bucket", "key", "len", F.col("head.key").alias("head"), F.col("head.len").alias("head_len"), "n")


class _Block:
    """Members of one part of a bucket, and the places of their common k-mers."""

    def __init__(self, members: list[tuple[bytes, bytes, bool, np.ndarray]]) -> None:
        self.members = members
        self.parent: dict[bytes, bytes] = {}
        self.sizes = np.array([len(m[3]) for m in members])
        flat = np.concatenate([m[3] for m in members])
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        self.kmers, self.first, self.last = ranked[first], first, np.append(first[1:], len(ranked))
        self.owner = np.repeat(np.arange(len(members)), self.sizes)[order]

    def root(self, x: bytes) -> bytes:
        while (y := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(y, y)
            x = y
        return x

    def links(self, key: bytes, root: bytes, kmers: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Links from a text outside the main component to members that it is not connected with."""
        at = np.minimum(np.searchsorted(self.kmers, kmers), len(self.kmers) - 1)
        at = at[self.kmers[at] == kmers]
        first, n = self.first[at], self.last[at] - self.first[at]
        places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[places], minlength=len(self.members))
        out = []
        for i in np.flatnonzero(common >= SIMILAR * (self.sizes + len(kmers) - common)).tolist():
            other, its_root, left, its_kmers = self.members[i]
            if left and other <= key:
                continue  # the other one of the two asks
            x, y = self.root(root), self.root(its_root)
            if x != y and aligned_similarity(kmers, its_kmers) >= SIMILAR:
                self.parent[x] = y
                out.append((key, other))
        return out


def _rest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows in the order of bucket and part: the part's own members, then those of other parts that ask it."""
    np.seterr(over="ignore")
    names = ("bucket", "part", "guest", "key", "root", "left", "text")
    at, members, block = None, [], None

    def own() -> list[tuple[bytes, bytes]]:
        nonlocal block
        block = _Block(members)
        return [x for key, root, left, kmers in members if left for x in block.links(key, root, kmers)]

    def made(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    for batch in batches:
        links: list[tuple[bytes, bytes]] = []
        for start in range(0, batch.num_rows, PAIRS_AT_ONCE):
            few = batch.slice(start, PAIRS_AT_ONCE)
            for bucket, part, guest, key, root, left, text in zip(*(few.column(c).to_pylist() for c in names), strict=True):
                if at != (bucket, part):
                    if members and block is None:
                        links += own()
                    at, members, block = (bucket, part), [], None
                if not guest:
                    members.append((key, root, left, labelled_kmers(text)))
                elif members:
                    if block is None:
                        links += own()
                    links += block.links(key, root, labelled_kmers(text))
        yield made(links)
    if members and block is None:
        yield made(own())


def _rest(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that join all components that the links within buckets join; ``roots`` are the components so far.

    Members outside a bucket's largest component meet all others of it, each in the part that holds it.
    """
    # the one pair of a bucket of two has been compared
    met = members.where("n > 2").select("bucket", "key", "len").join(maybe_broadcast(roots), "key", "left").withColumn("root", F.coalesce("root", "key"))
    met = checkpoint(met)
    per = met.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("len").alias("words"))
    per = per.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("words").alias("words")).where("roots > 1")
    per = checkpoint(per.select("bucket", F.col("main.root").alias("main"), F.ceil(F.col("words") / BLOCK_WORDS).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    rows = met.join(maybe_broadcast(per), "bucket").withColumns({"left": F.col("root") != F.col("main"), "mine": mine})
    rows = rows.withColumn("part", F.explode(F.when(F.col("left"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))))
    rows = rows.select("bucket", "part", (F.col("part") != F.col("mine")).alias("guest"), "key", "root", "left").join(texts, "key")
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "guest")
    return checkpoint(rows.mapInArrow(releasing(_rest_batches), "a binary, b binary"))


def find_links(sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between keys of different texts; ``sketches`` has key, len and sketch once for each key."""
    met = sketches.select("key", "len", F.posexplode("sketch").alias("j", "v")).select("key", "len", F.xxhash64("j", "v").alias("bucket"))
    shared = checkpoint(met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = shared.where(F.col("n") > max(HOT, total // HOT_BUCKETS)).select("bucket")  # HOT_BUCKETS at most
    hot = None if hot.isEmpty() else F.broadcast(hot)
    met = checkpoint(_beside(met, shared, hot))
    # the text that meets the most others is compared with them: of copies of one original, the one least changed
    ties = met.groupBy("key").agg(F.sum("n").alias("ties"))
    members = checkpoint(_stars(met.drop("n").join(ties, "key"), hot))
    keyed = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = checkpoint(members.select("key").distinct())
    texts = checkpoint(keyed.join(maybe_broadcast(wanted), "key", "left_semi").dropDuplicates(["key"]))
    pairs = members.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"), F.col("head_len").alias("la"), F.col("len").alias("lb")).distinct()
    links = checkpoint(_verify(pairs, texts).where("near").select("a", "b"))
    return links.unionByName(_rest(members, checkpoint(components(links)), texts))


def components(links: DataFrame) -> DataFrame:
    """(key, root): the lowest key of each linked key's component, by large-star and small-star steps."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = checkpoint(small)
        mark = small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen:  # the same links as a round before
            roots = small.select(F.col("u").alias("key"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("key"), "root").distinct())
        edges, seen = small, mark


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, key (digest of the text), class_id, is_kept.

    Null and empty texts are equal texts. Texts without words are linked to equal texts only. A null doc_id
    counts as a number from 2**62 on that its text gives. Repeated rows are in one class, and all of them
    are marked kept if their id is the class's. An empty table gives an empty result.
    """
    made = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(_sketch_batches), "doc_id long, key binary, len long, sketch array<long>"))
    rows = made.select("doc_id", "key", F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("key"), 3)).alias("did"))
    unique = checkpoint(made.dropDuplicates(["key"]).where(F.size("sketch") > 0).select("key", "len", "sketch"))
    roots = checkpoint(components(find_links(unique, docs)))
    per_key = rows.groupBy("key").agg(F.min("did").alias("low")).join(maybe_broadcast(roots), "key", "left").withColumn("root", F.coalesce("root", "key"))
    per_key = checkpoint(per_key)
    low = per_key.groupBy("root").agg(F.min("low").alias("class_id"))
    classes = per_key.join(low, "root").select("key", "class_id")
    return rows.join(classes, "key").select("doc_id", "key", "class_id", (F.col("did") == F.col("class_id")).alias("is_kept"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: the one of the lowest doc_id."""
    found = checkpoint(near_duplicates(docs))
    kept = found.where("is_kept").groupBy("class_id").agg(F.count("*").alias("n"), F.min("key").alias("__key"), F.min("doc_id").alias("__id"))
    kept = checkpoint(kept)
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    out = docs.withColumns({"__key": key, "__id": F.col("doc_id").cast("long")})
    same = out["__key"].eqNullSafe(F.col("k.__key")) & out["__id"].eqNullSafe(F.col("k.__id"))
    out = out.alias("d").join(maybe_broadcast(kept.select("__key", "__id")).alias("k"), same, "left_semi")
    if not kept.where("n > 1").isEmpty():  # repeated rows: one of each stays
        out = out.dropDuplicates(["__key", "__id"])
    return out.drop("__key", "__id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "is_kept")
