"""Splits, training pairs, multi-label scores, one-vs-rest regression and a contrastive projection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import safe_ratio
from .corpus import sample_order


def ranked(rows: DataFrame, by: str, order: Column, digits: int = 2) -> DataFrame:
    """Add rank (from 0) and size of each row's group in the order of a hex digest.

    Ranks run inside groups cut by the digest's first digits; the counts of those cuts, a small table, are summed up
    before. No task sorts a whole group.
    """
    cut = rows.withColumn("__o", order).withColumn("__c", F.substring("__o", 1, digits))
    counts = cut.groupBy(by, "__c").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(w), F.lit(0)), "size": F.sum("__n").over(Window.partitionBy(by))}).drop("__n")
    inner = F.row_number().over(Window.partitionBy(by, "__c").orderBy("__o"))
    return cut.withColumn("__i", inner).join(offsets, [by, "__c"]).withColumn("rank", F.col("__before") + F.col("__i") - 1).drop("__o", "__c", "__i", "__before")


def stratified_split(rows: DataFrame, stratum: str, seed: int, shares: Sequence[float] = (0.70, 0.15, 0.15), names: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Add split: the stratum's rows in digest order, cut at the shares. A stratum of one row is trained on."""
    r = ranked(rows, stratum, sample_order(seed, "id"))
    place = (F.col("rank") + 0.5) / F.col("size")
    split, upto = F.lit(names[-1]), 1.0
    for share, name in list(zip(shares, names, strict=True))[-2::-1]:
        upto = round(upto - shares[names.index(name) + 1], 6)
        split = F.when(place < upto, F.lit(name)).otherwise(split)
    return r.withColumn("split", F.when(F.col("size") == 1, F.lit(names[0])).otherwise(split)).drop("rank", "size")


def split_rows(rows: DataFrame, stratum: str, seed: int, shares: Sequence[float] = (0.70, 0.15, 0.15), names: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """A stratified split, or one without strata if a stratum has a single row and so cannot be parted."""
    least = rows.groupBy(stratum).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if least is None or least >= 2:
        return stratified_split(rows, stratum, seed, shares, names)
    return stratified_split(rows.withColumn("__one", F.lit(0)), "__one", seed, shares, names).drop("__one")


def positives(rows: DataFrame, per_anchor: int, seed: int, tags: str = "macros") -> DataFrame:
    """(a, b) of up to ``per_anchor`` rows that share a tag with each anchor, by digest.

    Partners come from an inverted index over (tag, slot): the rows of a tag are dealt to slots of bounded size by digest, so a
    tag of a third of all rows makes linearly many candidates.
    """
    each = rows.select("id", F.explode(tags).alias("tag")).distinct()
    r = ranked(each, "tag", sample_order(seed, "tag", "id"))
    slot = r.select("id", "tag", F.floor(F.col("rank") / (4 * per_anchor + 4)).alias("slot"))
    other = slot.select(F.col("id").alias("b"), "tag", "slot")
    pairs = slot.join(other, ["tag", "slot"]).where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b").distinct()
    order = F.row_number().over(Window.partitionBy("a").orderBy(sample_order(seed, "a", "b"), "b"))
    return pairs.withColumn("__r", order).where(F.col("__r") <= per_anchor).drop("__r")


def hard_negatives(neighbours: DataFrame, rows: DataFrame, per_anchor: int, tags: str = "macros") -> DataFrame:
    """(a, b) of each row's nearest neighbours that share no tag with it."""
    t = rows.select("id", tags)
    n = neighbours.join(t, "id").join(t.select(F.col("id").alias("neighbour"), F.col(tags).alias("__other")), "neighbour")
    order = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return n.where(~F.arrays_overlap(tags, "__other")).withColumn("__r", order).where(F.col("__r") <= per_anchor).select(F.col("id").alias("a"), F.col("neighbour").alias("b"))


def random_negatives(rows: DataFrame, per_anchor: int, seed: int, tags: str = "macros") -> DataFrame:
    """(a, b) of rows in digest order with the next ones that share no tag: neighbours in a random order are random partners."""
    order = sample_order(seed, "id")
    dealt = rows.select("id", tags, order.alias("__o")).withColumn("__c", F.substring("__o", 1, 2))
    w = Window.partitionBy("__c").orderBy("__o")
    near = F.array_compact(F.array(*(F.lead(F.struct(F.col("id"), F.col(tags))).over(w) if i == 1 else F.lead(F.struct(F.col("id"), F.col(tags)), i).over(w) for i in range(1, 2 * per_anchor + 1))))
    found = dealt.withColumn("__n", near)
    good = F.slice(F.filter("__n", lambda x: ~F.arrays_overlap(F.col(tags), x[tags])), 1, per_anchor)
    return found.select(F.col("id").alias("a"), F.explode(good).alias("x")).select("a", F.col("x.id").alias("b"))


def distinct_pairs(pairs: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """One row for each unordered pair and class: (a, b, y) with a < b; the source that is first in ``sources`` stays, or the first by name."""
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, sources)), F.col("source")), F.lit(0)), F.lit(len(sources) + 1)) if sources else F.lit(0)
    first = F.min(F.struct(order.alias("o"), "source")).alias("f")
    return pairs.select(lo, hi, "y", "source").groupBy("lo", "hi", "y").agg(first).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "y", F.col("f.source").alias("source"))


def force_one(scores: DataFrame) -> DataFrame:
    """(id, label, y_hat): labels of a score >= 0; the best one where none reaches it. ``scores`` has id, label, score."""
    top = scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "label")).alias("best"))
    return scores.join(top, "id").select("id", "label", ((F.col("score") >= 0) | ((F.col("best.neg") > 0) & (F.col("label") == F.col("best.label")))).cast("int").alias("y_hat"))


def multilabel_scores(pairs: DataFrame) -> DataFrame:
    """One row: macro, micro, weighted and per-row averages of precision, recall and F1, and subset accuracy; 0 for 0 / 0.

    ``pairs`` has id, label, y and y_hat for every row and label.
    """
    tp, fp, fn = (F.sum(x.cast("long")) for x in ((F.col("y") * F.col("y_hat")), (1 - F.col("y")) * F.col("y_hat"), F.col("y") * (1 - F.col("y_hat"))))

    def prf(df: DataFrame) -> DataFrame:
        p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
        return df.withColumns({"p": p, "r": r, "f": safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})

    label = prf(pairs.groupBy("label").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))
    support = F.col("tp") + F.col("fn")
    macro = label.agg(*(F.avg(c).alias(f"macro_{n}") for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))), *(safe_ratio(F.sum(F.col(c) * support), F.sum(support)).alias(f"weighted_{n}") for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))))
    micro = prf(label.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))).select(F.col("p").alias("micro_precision"), F.col("r").alias("micro_recall"), F.col("f").alias("micro_f1"))
    row = prf(pairs.groupBy("id").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))
    samples = row.agg(F.avg("f").alias("samples_f1"), F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double")).alias("subset_accuracy"))
    return micro.crossJoin(macro).crossJoin(samples)


def one_vs_rest(features: DataFrame, labels: Sequence[str], train: str = "train") -> DataFrame:
    """(id, split, label, score): a logistic regression for each label, fitted on the rows of one split.

    ``features`` has id, split, macros and v; the score is the log-odds.
    """
    # a step of a fit sends a result a task to the driver, so there are no more tasks than cores need
    tasks = 2 * int(features.sparkSession.sparkContext.defaultParallelism)
    x = features.select("id", "split", "macros", array_to_vector(F.col("v").cast("array<double>")).alias("features")).coalesce(tasks).persist()
    out = []
    for label in sorted(labels):
        y = x.withColumn("label", F.array_contains("macros", label).cast("double"))
        model = LogisticRegression(maxIter=50, regParam=1e-4).fit(y.where(F.col("split") == train))
        out.append(model.transform(y).select("id", "split", F.lit(label).alias("label"), vector_to_array("rawPrediction")[1].alias("score")))
    x.unpersist()
    return reduce(DataFrame.unionByName, out)


TRAIN_PAIRS = 20_000  # pairs that a projection is fitted to on the driver
ENTRIES_AT_ONCE = 1 << 16


def _blocks(batch: pa.RecordBatch, spaces: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first row, row after the last, (columns, weights, entries of each row) of each space) of a batch, about ``ENTRIES_AT_ONCE`` entries at a time."""
    sizes = [batch.column(f"at{i}").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(spaces)]
    ends, start = np.cumsum(sum(sizes)), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + ENTRIES_AT_ONCE, "right")))
        part = batch.slice(start, stop - start)
        flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        yield start, stop, [(flat(f"at{i}").astype(np.int64), flat(f"w{i}"), sizes[i][start:stop]) for i in range(spaces)]
        start = stop


def _odds(entries: Sequence[tuple], parts: Sequence[int], offsets: Sequence[int], coef: np.ndarray) -> np.ndarray:
    """Log-odds of rows under a set of spaces side by side; the last row of ``coef`` is the bias."""
    from .spaces import times

    return sum(times(at + offset, w, n, coef) for (at, w, n), offset in zip((entries[i] for i in parts), offsets, strict=True)) + coef[-1]


class _Descent:
    """L-BFGS with halved steps, one evaluation at a time: ``at`` is where the next value and gradient are wanted."""

    def __init__(self, size: int, memory: int = 8, tolerance: float = 1e-5):
        self.at = np.zeros(size)
        self.x, self.f, self.g, self.direction, self.step = self.at, np.inf, self.at, self.at, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.memory, self.tolerance, self.done = memory, tolerance, False

    def tell(self, f: float, g: np.ndarray) -> None:
        if f > self.f + 1e-4 * self.step * float(self.g @ self.direction):
            self.step /= 2
            self.done = self.step < 1e-8
            self.at = self.x if self.done else self.x + self.step * self.direction
            return
        if np.isfinite(self.f) and (y := g - self.g) @ (s := self.at - self.x) > 1e-12:
            self.pairs = [*self.pairs, (s, y)][-self.memory :]
        settled = np.isfinite(self.f) and self.f - f <= self.tolerance * 0.01 * max(1.0, abs(f))
        self.x, self.f, self.g = self.at, f, g
        self.done = bool(settled or np.abs(g).max(initial=0) < self.tolerance)
        if self.done:
            return
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            kept.append((a := (s @ q) / (s @ y), s, y))
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for a, s, y in reversed(kept):
            q += (a - (y @ q) / (s @ y)) * s
        self.direction, self.step = -q, 1.0 if self.pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        self.at = self.x + self.step * self.direction


def fit_one_vs_rest(rows: DataFrame, sizes: Sequence[int], sets: Sequence[Sequence[int]], labels: int, alpha: float = 1e-4, passes: int = 60) -> list[np.ndarray]:
    """Coefficients (features and a bias, by labels) of logistic regressions of all labels for each of ``sets``, fitted to all of ``rows``.

    ``rows`` has y (array of 0 and 1 by label) and at0, w0, at1, w1 ...: sparse rows of spaces of the given sizes; a set is some of the spaces side by side. A pass
    over the rows gives all sets' values and gradients: one task a partition, summed before they reach the driver, which holds no row.
    """
    sc = rows.sparkSession.sparkContext
    offsets = [[sum(sizes[i] for i in parts[:k]) for k in range(len(parts))] for parts in sets]
    shapes = [(sum(sizes[i] for i in parts) + 1, labels) for parts in sets]
    descents = [_Descent(a * b) for a, b in shapes]
    rows = rows.coalesce(2 * int(sc.defaultParallelism)).persist()
    n = rows.count()
    schema = "at int, body binary"

    def summed(table: pa.Table) -> pa.Table:
        body = sum(np.frombuffer(b.as_py(), np.float64) for b in table.column("body"))
        return pa.table({"at": table.column("at")[:1], "body": pa.array([body.tobytes()], pa.binary())})

    for _ in range(passes if n else 0):
        todo = [k for k, d in enumerate(descents) if not d.done]
        if not todo:
            break
        shared = sc.broadcast({k: descents[k].at.reshape(shapes[k]) for k in todo})

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(c.size + 1) for k, c in shared.value.items()}  # noqa: B023
            for batch in batches:
                truth = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, labels)
                for start, stop, entries in _blocks(batch, len(sizes)):
                    y, row_of = truth[start:stop], [np.repeat(np.arange(stop - start), n) for _, _, n in entries]
                    for k, coef in shared.value.items():  # noqa: B023
                        odds = _odds(entries, sets[k], offsets[k], coef)
                        total[k][-1] += float((np.logaddexp(0, odds) - y * odds).sum())
                        error, g = 1 / (1 + np.exp(-np.clip(odds, -500, 500))) - y, total[k][:-1].reshape(coef.shape)
                        g[-1] += error.sum(0)
                        for i, offset in zip(sets[k], offsets[k], strict=True):
                            at, w, _ = entries[i]
                            for c in range(labels):
                                g[offset : offset + sizes[i], c] += np.bincount(at, w * error[row_of[i], c], minlength=sizes[i])
            for k, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["at", "body"])

        for r in rows.mapInArrow(partial, schema).groupBy("at").applyInArrow(summed, schema).collect():
            k, x = r["at"], np.frombuffer(r["body"], np.float64) / n
            weights = descents[k].at.reshape(shapes[k]).copy()
            weights[-1] = 0  # the bias is not held back
            descents[k].tell(float(x[-1]) + alpha / 2 * float((weights * weights).sum()), x[:-1] + alpha * weights.ravel())
        shared.unpersist()
    rows.unpersist()
    return [d.x.reshape(s) for d, s in zip(descents, shapes, strict=True)]


def one_vs_rest_scores(rows: DataFrame, sizes: Sequence[int], sets: Mapping[str, Sequence[int]], labels: Sequence[str], train: str = "train", alpha: float = 1e-4) -> DataFrame:
    """(feature_set, id, split, label, y, score): regressions of all labels for each set of spaces, fitted to all rows of one split; the score is the log-odds, and every row is scored.

    ``rows`` has id, split, macros and the spaces' at0, w0, at1, w1 ...
    """
    names, parts = sorted(labels), list(sets.values())
    marked = rows.withColumn("y", F.array(*(F.array_contains("macros", c).cast("double") for c in names)))
    spaces = [f"{c}{i}" for i in range(len(sizes)) for c in ("at", "w")]
    found = fit_one_vs_rest(marked.where(F.col("split") == train).select("y", *spaces), sizes, parts, len(names), alpha)
    shared = rows.sparkSession.sparkContext.broadcast(found)  # features x labels
    offsets = [[sum(sizes[i] for i in p[:k]) for k in range(len(p))] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, entries in _blocks(batch, len(sizes)):
                part = batch.slice(start, stop - start)
                y = part.column("y").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(names)).astype(np.int32)
                for name, p, offset, coef in zip(sets, parts, offsets, shared.value, strict=True):
                    odds = _odds(entries, p, offset, coef)
                    for i, label in enumerate(names):
                        same = [pa.array([x] * part.num_rows, pa.string()) for x in (name, label)]
                        yield pa.RecordBatch.from_arrays([same[0], part.column("id"), part.column("split"), same[1], pa.array(y[:, i]), pa.array(odds[:, i])], ["feature_set", "id", "split", "label", "y", "score"])

    return marked.select("id", "split", "y", *spaces).mapInArrow(run, f"feature_set string, id {rows.schema['id'].dataType.simpleString()}, split string, label string, y int, score double")


def sparse_one_vs_rest(features: DataFrame, size: int, labels: Sequence[str], train: str = "train", alpha: float = 1e-4) -> DataFrame:
    """(id, split, label, y, score): the same for one space; ``features`` has id, split, macros, at and w (sparse rows below ``size``)."""
    rows = features.select("id", "split", "macros", F.col("at").alias("at0"), F.col("w").alias("w0"))
    return one_vs_rest_scores(rows, [size], {"": [0]}, labels, train, alpha).drop("feature_set")


def train_projection(a: np.ndarray, b: np.ndarray, y: np.ndarray, dimensions: int = 64, margin: float = 0.2, epochs: int = 20, rate: float = 1e-3, decay: float = 1e-2, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """Weights of tanh(x W) of unit length, fitted to y (1 - s)^2 + (1 - y) max(0, s - margin)^2 by AdamW; and the loss of each epoch."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, a.shape[1] ** -0.5, (a.shape[1], dimensions))
    m1, m2, step, losses = np.zeros_like(w), np.zeros_like(w), 0, []
    for _ in range(epochs):
        order, total = rng.permutation(len(y)), 0.0
        for at in range(0, len(order), 256):
            i = order[at : at + 256]
            ha, hb = np.tanh(a[i] @ w), np.tanh(b[i] @ w)
            na, nb = (np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12) for h in (ha, hb))
            ua, ub = ha / na, hb / nb
            s = (ua * ub).sum(1)
            over = np.maximum(0, s - margin)
            total += float((y[i] * (1 - s) ** 2 + (1 - y[i]) * over**2).sum())
            ds = ((-2 * y[i] * (1 - s) + 2 * (1 - y[i]) * over) / len(i))[:, None]
            ga = (ub - s[:, None] * ua) / na * ds * (1 - ha * ha)
            gb = (ua - s[:, None] * ub) / nb * ds * (1 - hb * hb)
            g = a[i].T @ ga + b[i].T @ gb
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w -= rate * (m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8) + decay * w)
        losses.append(total / max(1, len(y)))
    return w, losses


def project(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, v) through fitted weights, of unit length, in Arrow batches."""
    import pandas as pd

    def run(frames):
        for f in frames:
            h = np.tanh(np.stack(f["v"].to_numpy()).astype(np.float64) @ weights) if len(f) else np.zeros((0, weights.shape[1]))
            h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": f["id"], "v": list(h)})

    return vectors.select("id", "v").mapInPandas(run, "id long, v array<double>")
