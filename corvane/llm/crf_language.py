"""Language identification by a linear-chain conditional random field over words.

Each word's score for each language sums learned weights of its affixes, character n-grams and, for words frequent in the training
sample, of the word itself (the lexicon); learned transitions join neighbouring words. The forward-backward
algorithm gives each word's posterior, so that code-switched text gets a label for each word, and a document's language is the one with
the largest posterior mass over all its words; the score is that language's mean posterior.

Training takes a bounded sample: at most ``DOCS_A_LANG`` documents of each language (the lowest digests of id and text); of a text of more than
``TRAIN_CHARS`` characters, as many in evenly spread stretches reach the driver. Of each, ``SEGMENTS``
segments of ``SEGMENT_WORDS`` words spread evenly are learned from. Half of the training sequences are spliced from
two languages, so that transitions between languages are seen. Prediction covers every word of every text. A long text is
one chain: its runs of ``RUN_WORDS`` words are worked on side by side, and the product of each run's transition and emission
matrices carries the forward vector into the next run and the backward vector into the one before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import releasing, table

DOCS_A_LANG = 400
TRAIN_CHARS = 50_000
SEGMENTS = 6
SEGMENT_WORDS = 24
RUN_WORDS = 1024
FEATURES = 60_000
TABLE_WORDS = 250_000
DOCS_AT_ONCE = 256
RUNS_AT_ONCE = 256
MIN_SCORE = 0.4
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokenize(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall((text or "").lower())
    if not found or "".join(found).isalpha():
        return found
    # fractions, superscripts and the like are word characters, but no letters
    return "".join([c if c.isalpha() else " " for w in found for c in (*w, " ")]).split()


def features(word: str) -> list[str]:
    """Names of a word's features: affixes, n-grams with borders, and the word."""
    x = f"^{word}$"
    out = [x[i : i + 2] for i in range(len(x) - 1)]
    out += [x[i : i + 3] for i in range(len(x) - 2)]
    out += ["<" + word[:3], "<" + word[:4], ">" + word[-3:], ">" + word[-4:], "=" + word, "*"]
    return out


@dataclass
class Crf:
    """Weights by feature and label, and transition weights between labels."""

    labels: list[str]
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission score of each word and label."""
        ids, starts = [], []
        get = self.index.get
        for w in words:
            starts.append(len(ids))
            ids += [i for f in features(w) if (i := get(f)) is not None]
            if starts[-1] == len(ids):
                ids.append(self.index["*"])
        return np.add.reduceat(self.weights[ids], starts, axis=0) if words else np.zeros((0, len(self.labels)), np.float32)


def forward_backward(
    emit: np.ndarray, mask: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, forward, backward) of sequences (n, time, labels); forward and backward are scaled to sum 1.

    ``mask`` marks the words; each sequence's words come first. ``before`` has what the words before hand on to each
    sequence's first word (all ones if there are none), ``after`` the backward vector of its last one.
    """
    n, steps, labels = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    forward, backward = np.empty((steps, n, labels)), np.empty((steps, n, labels))
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    a = e[0] if before is None else e[0] * before
    a = a / a.sum(1, keepdims=True)
    forward[0] = a
    for k in range(1, steps):
        a = (a @ t) * e[k]
        a /= a.sum(1, keepdims=True)
        forward[k] = a
    last = np.full((n, labels), 1.0 / labels) if after is None else after
    b = last
    live = mask.T[:, :, None]
    backward[-1] = b
    for k in range(steps - 2, -1, -1):
        c = (b * e[k + 1]) @ t.T
        c /= c.sum(1, keepdims=True)
        b = np.where(live[k + 1], c, last)
        backward[k] = b
    post = forward * backward
    post /= post.sum(2, keepdims=True)
    return post.transpose(1, 0, 2), forward, backward


def products(emit: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Of each sequence: the product of its emissions and the transitions between its words, scaled to sum 1 (n, labels, labels)."""
    n, steps, labels = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    p = np.eye(labels)[None] * e[:, 0, None, :]
    for k in range(1, steps):
        q = (p @ t) * e[:, k, None, :]
        p = np.where(mask[:, k, None, None], q / q.sum((1, 2), keepdims=True), p)
    return p / p.sum((1, 2), keepdims=True)


def _sequences(samples: list[tuple[str, str]], labels: list[str], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    pieces: list[tuple[list[str], int]] = []
    for text, lang in samples:
        words = tokenize(text)
        n = max(1, min(SEGMENTS, len(words) // SEGMENT_WORDS))
        for at in np.linspace(0, max(0, len(words) - SEGMENT_WORDS), n).astype(int).tolist():
            if piece := words[at : at + SEGMENT_WORDS]:
                pieces.append((piece, labels.index(lang)))
    out = []
    other = rng.permutation(len(pieces)).tolist()
    for i, (words, y) in enumerate(pieces):
        more, z = pieces[other[i]]
        if i % 2 and z != y:
            a, b = int(rng.integers(1, len(words) + 1)), int(rng.integers(0, len(more)))
            words, ys = words[:a] + more[b:], [y] * a + [z] * (len(more) - b)
        else:
            ys = [y] * len(words)
        out.append((words, ys))
    return out


def train(samples: list[tuple[str, str]], epochs: int = 4, batch: int = 128, rate: float = 0.3, decay: float = 1e-5) -> Crf:
    """Fit by AdaGrad on the conditional log-likelihood. ``samples`` are (text, language); the same samples give the same model."""
    labels = sorted({lang for _, lang in samples})
    crf = Crf(labels)
    rng = np.random.default_rng(7)
    seqs = _sequences(sorted(samples), labels, rng)
    counts = Counter(chain.from_iterable(features(w) for words, _ in seqs for w in words))
    kept = [f for f, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c >= 2 or f == "*"][:FEATURES]
    crf.index = {f: i for i, f in enumerate(dict.fromkeys(["*", *kept]))}
    m, n_labels = len(crf.index), len(labels)
    w, t = np.zeros((m, n_labels)), np.zeros((n_labels, n_labels))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    cache: dict[str, list[int]] = {}
    for _ in range(epochs if n_labels > 1 else 0):
        order = rng.permutation(len(seqs)).tolist()
        for k in range(0, len(order), batch):
            part = [seqs[i] for i in order[k : k + batch]]
            steps = max(len(x) for x, _ in part)
            mask = np.zeros((len(part), steps), bool)
            y = np.zeros((len(part), steps), np.int64)
            ids, starts = [], []
            for i, (words, ys) in enumerate(part):
                mask[i, : len(words)] = True
                y[i, : len(ys)] = ys
                for word in words:
                    if word not in cache:
                        cache[word] = [j for f in features(word) if (j := crf.index.get(f)) is not None] or [0]
                    starts.append(len(ids))
                    ids += cache[word]
            ids, starts = np.array(ids), np.array(starts)
            emit = np.zeros((*mask.shape, n_labels))
            emit[mask] = np.add.reduceat(w[ids], starts, axis=0)
            post, forward, backward = forward_backward(emit, mask, t)
            gold = np.eye(n_labels)[y]
            delta = (gold - post)[mask]
            per = np.repeat(delta, np.diff(np.append(starts, len(ids))), axis=0)
            g = np.stack([np.bincount(ids, per[:, c], m) for c in range(n_labels)], 1) / len(part) - decay * w
            e = np.exp(emit - emit.max(2, keepdims=True)).transpose(1, 0, 2)
            pair = forward[:-1, :, :, None] * np.exp(t) * (e[1:] * backward[1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            both = mask[:, 1:].T
            seen = np.zeros_like(t)
            np.add.at(seen, (y[:, :-1].T[both], y[:, 1:].T[both]), 1)
            ht = (seen - pair[both].sum(0)) / len(part) - decay * t
            gw += g * g
            gt += ht * ht
            w += rate * g / np.sqrt(gw)
            t += rate * ht / np.sqrt(gt)
    crf.weights, crf.transitions = w.astype(np.float32), t
    return crf


class Labeller:
    """Labels texts; keeps the emission scores of words it has seen, up to a bound."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.words: dict[str, int] = {}
        self.scores = np.zeros((0, len(crf.labels)), np.float32)

    def _emissions(self, texts: list[list[str]]) -> np.ndarray:
        wanted = set(chain.from_iterable(texts))
        new = sorted(wanted.difference(self.words))
        if len(self.words) + len(new) > TABLE_WORDS:
            self.words, self.scores, new = {}, self.scores[:0], sorted(wanted)
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.scores = np.concatenate((self.scores, self.crf.scores(new))) if new else self.scores
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(texts)), np.int64)
        return self.scores[at]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Posterior of each word's labels, for each tokenised text."""
        n = np.array([len(t) for t in texts], np.int64)
        emissions = self._emissions(texts)
        labels, transitions = len(self.crf.labels), self.crf.transitions
        count = -(-n // RUN_WORDS)
        first = np.cumsum(count) - count  # each text's first run
        of = np.repeat(np.arange(len(n)), count)
        nth = np.arange(count.sum()) - first[of]
        start = (np.cumsum(n) - n)[of] + nth * RUN_WORDS
        length = np.minimum(RUN_WORDS, n[of] - nth * RUN_WORDS)
        out = np.empty(emissions.shape)

        def parts(runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(runs, places of their words, which of those are words) of runs of like length."""
            runs = runs[np.argsort(length[runs], kind="stable")]
            for k in range(0, len(runs), RUNS_AT_ONCE):
                part = runs[k : k + RUNS_AT_ONCE]
                steps = np.arange(length[part].max())
                mask = steps[None] < length[part, None]
                yield part, np.where(mask, start[part, None] + steps[None], start[part, None]), mask

        before, after = np.ones((len(of), labels)), np.full((len(of), labels), 1.0 / labels)
        chained = np.flatnonzero(count > 1)
        if len(chained):
            product = np.empty((len(of), labels, labels))
            for part, at, mask in parts(np.flatnonzero(count[of] > 1)):
                product[part] = products(emissions[at].astype(np.float64), mask, transitions)
            t = np.exp(transitions - transitions.max())
            for text in chained.tolist():
                a, z = int(first[text]), int(first[text] + count[text])
                for r in range(a + 1, z):
                    v = (before[r - 1] @ product[r - 1]) @ t
                    before[r] = v / v.sum()
                for r in range(z - 2, a - 1, -1):
                    v = t @ (product[r + 1] @ after[r + 1])
                    after[r] = v / v.sum()
        for part, at, mask in parts(np.arange(len(of))):
            out[at[mask]] = forward_backward(emissions[at].astype(np.float64), mask, transitions, before[part], after[part])[0][mask]
        return np.split(out, np.cumsum(n)[:-1]) if texts else []

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """(language, score, runs of (language, words)) of each text."""
        words = [tokenize(t) for t in texts]
        out = []
        if not self.crf.labels:
            return [(UNDETERMINED, 0.0, []) for _ in texts]
        for post in self.posteriors(words):
            if not len(post):
                out.append((UNDETERMINED, 0.0, []))
                continue
            mean = post.mean(0)
            best = int(mean.argmax())
            y = post.argmax(1)
            cuts = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
            sizes = np.diff(np.append(cuts, len(y)))
            out.append((self.crf.labels[best], min(1.0, float(mean[best])), [(self.crf.labels[a], b) for a, b in zip(y[cuts].tolist(), sizes.tolist(), strict=True)]))
        return out


def fit(docs: DataFrame, docs_a_lang: int = DOCS_A_LANG) -> Crf:
    """Train on a bounded sample of the documents that are not held out and have a language and a letter."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a number a language
    digest = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * docs_a_lang / n))).otherwise(share)
    n, most = F.char_length("text"), TRAIN_CHARS // SEGMENTS
    stretches = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: F.substring("text", (1 + i * (n - most) / (SEGMENTS - 1)).cast("int"), F.lit(most)))
    excerpt = F.when(n <= TRAIN_CHARS, F.col("text")).otherwise(F.array_join(stretches, "\n"))
    rows = usable.select(excerpt.alias("text"), "lang", digest.alias("digest")).where((F.col("digest") / float(1 << 63) + 1) / 2 <= share).collect()
    samples: list[tuple[str, str]] = []
    for lang in sorted(counts):
        mine = sorted((r["digest"], r["text"]) for r in rows if r["lang"] == lang and tokenize(r["text"]))
        samples += [(text, lang) for _, text in mine[:docs_a_lang]]
    return train(samples)


def label_documents(docs: DataFrame, crf: Crf, with_runs: bool = True, with_text: bool = False) -> DataFrame:
    """Columns of ``docs`` but its text (unless ``with_text``), plus lang_pred, score and, if asked for, runs (the code-switched stretches, in words).

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no language was
    learned. Repeated rows get equal answers. Columns that bear a result column's name are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "runs") and (with_text or c != "text")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema]
    schema = ", ".join([*kinds, "lang_pred string", "score double"] + ["runs array<struct<lang: string, words: int>>"] * with_runs)
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # FEATURES rows at most
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                made = labeller.label(part.column("text").to_pylist())
                columns = [part.column(c) for c in others] + [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
                names = [*others, "lang_pred", "score"]
                if with_runs:
                    columns.append(pa.array([[{"lang": a, "words": b} for a, b in m[2]] for m in made], run_type))
                    names.append("runs")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*others, *([] if with_text else ["text"])).mapInArrow(releasing(run), schema)


def accepted(lang_pred: Column, score: Column, min_score: float = MIN_SCORE) -> Column:
    """Documents in one language for the most part."""
    return (lang_pred != UNDETERMINED) & (score >= min_score)


def stage(docs: DataFrame) -> DataFrame:
    """The documents that have letters and one main language, with their own columns."""
    crf = fit(docs)
    return label_documents(docs, crf, with_runs=False, with_text=True).where(accepted(F.col("lang_pred"), F.col("score"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = label_documents(docs.select("doc_id", "text"), fit(docs), with_runs=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
