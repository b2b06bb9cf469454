"""Histogram sort: shards of near equal bytes in key order, with one exchange.

Rows are ordered by (crc32 of the text, doc_id), so that equal texts lie side by side, and a large
group of them can still be cut anywhere by its ids. Candidate boundaries are refined round by round:
each round counts the exact rows and bytes between evenly spaced probes inside the intervals that
still hold an unmet target, first over the leading key and, where one leading key holds the boundary
(a hot group), over the second. Only these counts (a few numbers a probe) reach the driver. Then every row finds its
range by a comparison tree, and one exchange by range numbers the rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpoint, table

PIECE_BYTES = 512 << 20  # texts of one range, which one task sorts
TREE_STARTS = 1024
COUNTS = 1 << 20  # counts that reach the driver in a round
_MIN, _MAX = -(1 << 62), (1 << 62) - 1  # second keys beyond are drawn in, so that differences fit a long


@dataclass(frozen=True)
class Splitter:
    """Rows whose (k1, k2) is smaller lie below: ``rows`` of them with ``bytes`` bytes."""

    k1: int
    k2: int
    rows: int
    bytes: int


@dataclass
class _Open:
    """An interval [lo, hi) of one key that holds a target; rows and bytes below lo are known."""

    target: int
    lo: int
    hi: int
    rows: int
    bytes: int
    hi_rows: int
    hi_bytes: int
    fixed: int | None = None  # the leading key, once the second key is searched

    def step(self, probes: int) -> int:
        return max(1, -(-(self.hi - self.lo) // probes))

    def best(self, tolerance: float) -> Splitter | None:
        """The boundary, if either end is within tolerance or no key lies between the ends."""
        low, high = self.target - self.bytes, self.hi_bytes - self.target
        near_low = low <= high
        alone = self.hi_rows - self.rows <= 1 or (self.hi - self.lo == 1 and self.fixed is not None)
        if min(low, high) > tolerance and not alone:
            return None
        key, rows, size = (self.lo, self.rows, self.bytes) if near_low else (self.hi, self.hi_rows, self.hi_bytes)
        return Splitter(key, _MIN, rows, size) if self.fixed is None else Splitter(self.fixed, key, rows, size)


def _tree(starts: Sequence[tuple[int, int]]) -> Column:
    """How many of the sorted starts are <= (k1, k2): a tree of comparisons, or a binary search in arrays if they are many."""
    if len(starts) > TREE_STARTS:
        k1s, k2s = F.lit([k1 for k1, _ in starts]), F.lit([k2 for _, k2 in starts])
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(starts).bit_length()))))

        def further(at: Column, step: Column) -> Column:
            k1, k2 = F.get(k1s, at + step - 1), F.get(k2s, at + step - 1)
            reached = (k1 < F.col("__k1")) | ((k1 == F.col("__k1")) & (k2 <= F.col("__k2")))
            return F.when(F.coalesce(reached, F.lit(False)), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), further)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        k1, k2 = starts[mid]
        below = (F.col("__k1") < F.lit(k1)) | ((F.col("__k1") == F.lit(k1)) & (F.col("__k2") < F.lit(k2)))
        return F.when(below, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(starts))


def _longs(values: Sequence[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values)) if len(values) <= TREE_STARTS else F.lit(list(values)).cast("array<bigint>")


def _count(keys: DataFrame, opens: list[_Open], probes: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Exact rows and bytes in each probe's bucket: {(interval, bucket): (rows, bytes)}."""
    start = lambda o: (o.lo, _MIN) if o.fixed is None else (o.fixed, o.lo)
    distinct = sorted({start(o): o for o in opens}.values(), key=start)
    at = keys.withColumn("i", _tree([start(o) for o in distinct])).where("i > 0")
    pick = lambda values: F.get(_longs(values), F.col("i") - 1)
    second = pick([o.fixed is not None for o in distinct]) == 1
    found = (
        at.withColumn("key", F.when(second, F.col("__k2")).otherwise(F.col("__k1")))
        .where((F.col("key") < pick([o.hi for o in distinct])) & (~second | (F.col("__k1") == pick([o.fixed or 0 for o in distinct]))))
        .withColumns({"lo": pick([o.lo for o in distinct]), "step": pick([o.step(probes) for o in distinct])})
        .groupBy("i", F.expr("(key - lo) div step").alias("b"))
        .agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        .collect()
    )
    by = {(r["i"] - 1, r["b"]): (r["n"], r["s"]) for r in found}
    index = {start(o): i for i, o in enumerate(distinct)}
    return {(j, b): v for j, o in enumerate(opens) for (i, b), v in by.items() if i == index[start(o)]}


def find_splitters(keys: DataFrame, parts: int, tolerance: float = 0.0005, probes: int | None = None) -> list[Splitter]:
    """``parts - 1`` splitters of ``keys`` (k1, k2, size), each within tolerance (a share of a part) or exact.

    At most a few rounds a key: every round divides an interval by ``probes``. Counted rows, not
    samples, decide; the driver gets parts * probes counts at most (``COUNTS``, unless there are more parts than a quarter of that).
    """
    probes = probes or max(4, min(256, COUNTS // parts))
    total = keys.agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.min("__k1").alias("lo"), F.max("__k1").alias("hi")).first()
    if not total["n"]:
        return []
    n, size = total["n"], total["s"]
    allowed = tolerance * size / parts
    opens = [_Open(size * i // parts, total["lo"], total["hi"] + 1, 0, 0, n, size) for i in range(1, parts)]
    done: dict[int, Splitter] = {}
    live = dict(enumerate(opens))
    while live:
        order = list(live)
        counts = _count(keys, [live[i] for i in order], probes)
        for j, i in enumerate(order):
            o, width = live[i], live[i].step(probes)
            rows, size_below = o.rows, o.bytes
            for b in range(-(-(o.hi - o.lo) // width)):
                c = counts.get((j, b), (0, 0))
                if size_below + c[1] >= o.target:
                    lo = o.lo + b * width
                    live[i] = o = _Open(o.target, lo, min(o.hi, lo + width), rows, size_below, rows + c[0], size_below + c[1], o.fixed)
                    break
                rows, size_below = rows + c[0], size_below + c[1]
            if best := o.best(allowed):
                done[i] = best
                del live[i]
            elif o.hi - o.lo == 1:  # the second key from here on
                live[i] = _Open(o.target, _MIN, _MAX + 1, o.rows, o.bytes, o.hi_rows, o.hi_bytes, o.lo)
    return sorted((done[i] for i in done), key=lambda s: (s.k1, s.k2))


def range_of(splitters: Sequence[Splitter]) -> Column:
    """Number of the range that (k1, k2) falls in."""
    return _tree([(s.k1, s.k2) for s in splitters])


def histogram_sort(
    docs: DataFrame, shards: int = 16, pieces: int | None = None, tolerance: float = 0.0005, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """All rows and columns of ``docs`` plus size, text_crc32, shard and slot.

    A shard is ``pieces`` neighbouring ranges (by default as many as keep a range below ``PIECE_BYTES``, and four at least), so that no task
    sorts a whole shard; slot runs from 0 without a gap in key order through each shard. Shards differ in bytes by the tolerance or by the one row
    that straddles a boundary.

    A null text has size 1 and the crc32 of the empty text, a null key sorts first, rows alike in both
    keys stay in one range, keys beyond 2**62 on either side count as that bound (so their rows have no order of their own), an empty table gives an empty result. Columns of ``docs`` that bear the name of a
    result column are replaced by it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    made = {"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary"))}
    keyed = docs.withColumns(made).withColumns({"__k1": F.col("text_crc32"), "__k2": F.greatest(F.lit(_MIN), F.least(F.lit(_MAX), F.coalesce(F.col(key).cast("long"), F.lit(_MIN))))})
    keys = checkpoint(keyed.select("__k1", "__k2", "size"))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pieces = pieces or max(4, -(-total // (shards * PIECE_BYTES)))
    splitters = find_splitters(keys, shards * pieces, tolerance)
    if not splitters:
        return keyed.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("__k1", "__k2")
    below = [0, *(s.rows for s in splitters)]
    start = [below[i - i % pieces] if i - i % pieces < len(below) else below[-1] for i in range(len(below))]
    offsets = _longs([b - s for b, s in zip(below, start, strict=True)])
    ranged = keyed.withColumn("__range", range_of(splitters))
    order = Window.partitionBy("__range").orderBy("__k1", "__k2")
    return (
        ranged.withColumn("slot", F.get(offsets, F.col("__range")) + F.row_number().over(order) - 1)
        .withColumn("shard", F.floor(F.col("__range") / pieces).cast("int"))
        .drop("__k1", "__k2", "__range")
    )


def shard_of(splitters: Sequence[Splitter], pieces: int, k1: int, k2: int) -> int:
    """The shard of one key, as a reader that looks up a document needs it."""
    return bisect_right([(s.k1, s.k2) for s in splitters], (k1, k2)) // pieces


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_sort(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
