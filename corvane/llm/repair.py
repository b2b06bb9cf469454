"""Token-id files compressed by a Re-Pair grammar per shard, with random access.

Documents are tokenised in ascending doc_id order, each followed by the end id, and cut into shards of about ``SHARD_IDS`` ids. In
a shard, frequent pairs of neighbouring symbols are replaced by new symbols, round after round, over
the symbols of the round before, until no pair stands ``FREQUENT`` times; a pair never spans two documents. The file of a
shard holds its rules, each rule's expansion length, the symbols and where each document begins, so one document, or any run of
ids, is decoded without the rest.

A file is a binary value of a Parquet table in the shared folder, beside its range number and order: any store that Spark reaches holds it.

File layout (little-endian): ``CRPG``, u32 version, u32 vocabulary, u64 documents, u64 rules, u64 symbols; u8 of each document, 1 if its doc_id
is null; i64 doc_id of each document; u64 first symbol of each document and the end; u64 first id of each document and the end;
left and right of each rule; u32 expansion length of each rule; symbols. Symbols, left and right are u16 if vocabulary and rules
together allow it, u32 else.

Pre-tokens cannot span a space or line feed between two other characters, so a text is its chunks between these, one after the other. Each
worker keeps a table of the ids of distinct chunks; new ones are encoded by the library, and those of letters with punctuation after them by the
library's BPE model, a pre-token at a time. All the rest works on arrays.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import IdTable, digests, slices, text_bytes
from ._common import ensure_checkpoint_dir, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SHARD_IDS = 1 << 18
FREQUENT = 8
TABLE_CHUNKS = 2_000_000  # bound on the memory of a worker's table: it costs time alone
BYTES_AT_ONCE = 4 << 20
_MAGIC = b"CRPG"
_HEAD = struct.Struct("<4sIIQQQ")
#: By byte: 1 for a blank or line feed, 2 for other ASCII white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 28, 29, 30, 31]] = 2
_CLASS[[10, 32]] = 1
_LETTERS = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level BPE: itself if it is visible, one from 256 on else."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in seen else next(rest) for b in range(256)}


def _white(raw: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a white space character."""
    white = _CLASS[raw] > 0
    if len(raw) > 2:
        wide = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
        wide = wide[wide < len(raw) - 1]
        lead, second = raw[wide], raw[wide + 1]
        two = wide[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0))]
        white[two] = white[two + 1] = True
        wide, lead, second = (x[wide < len(raw) - 2] for x in (wide, lead, second))
        third = raw[wide + 2]
        spaces = (lead == 0xE1) & (second == 0x9A) & (third == 0x80)
        spaces |= (lead == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
        spaces |= (lead == 0xE2) & (second == 0x81) & (third == 0x9F)
        spaces |= (lead == 0xE3) & (second == 0x80) & (third == 0x80)
        three = wide[spaces]
        white[three] = white[three + 1] = white[three + 2] = True
    return white


def chunk_spans(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk starts, and how many each text has.

    A blank or line feed with other characters on both sides begins a chunk, and so does what follows such a line feed.
    """
    white = np.ones(len(raw) + 2, bool)
    white[1:-1] = _white(raw)
    edge = np.zeros(len(raw) + 1, bool)
    edge[begin] = True
    at = np.flatnonzero((raw == 32) | (raw == 10))
    at = at[~white[at] & ~white[at + 2] & ~edge[at] & ~edge[at + 1]]
    cut = edge
    cut[at] = True
    cut[at[raw[at] == 10] + 1] = True
    cut[len(raw)] = False
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.searchsorted(starts, begin))


class ChunkTable:
    """Encodes texts as the library does, each distinct chunk once as long as the table holds it."""

    def __init__(self, file: str, most: int = TABLE_CHUNKS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.bpe = self.model.model
        self.size = self.model.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.table = IdTable(most, self.kind)
        self.letters = _byte_letters()
        probe = "One, two\nthree four. It's été; naïve (ok)\n42nd"
        parts = [" two", ",", " été", "One", "\n", " naïve"]
        whole = self.model.encode(probe, add_special_tokens=False).ids
        self.direct = [self._letters(p) for p in parts] == [self.model.encode(p, add_special_tokens=False).ids for p in parts]
        self.splits = True
        self.splits = np.concatenate(list(self.encode([probe]))).tolist() == whole

    def _letters(self, part: str) -> list[int]:
        """Ids of one pre-token, by the library's BPE alone."""
        spelt = part.replace(" ", self.letters[32]) if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.bpe.tokenize(spelt)]

    def _learned(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk: letters and the punctuation after them are two pre-tokens, other chunks are for the whole library."""
        out: list[list[int] | None] = [None] * len(chunks)
        known: dict[str, list[int]] = {"": []}
        if self.direct:
            for i, m in enumerate(map(_LETTERS.fullmatch, chunks)):
                if m:
                    word, mark = m.groups()
                    if word not in known:
                        known[word] = self._letters(word)
                    if mark not in known:
                        known[mark] = self._letters(mark)
                    out[i] = known[word] + known[mark] if mark else known[word]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.model.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row of each chunk, learned where it is new."""
        h = digests(raw, starts, ends)
        rows = self.table.find(h)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self.table.make_room(len(new)):
                rows = self.table.find(h)
                missing = np.flatnonzero(rows < 0)
                new, first = np.unique(h[missing], return_index=True)
            self.table.mark(rows[rows >= 0])
            first = missing[first]
            body = raw.tobytes()
            ids = self._learned([body[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            self.table.add(new, np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)))
            rows[missing] = self.table.find(h[missing])
        else:
            self.table.mark(rows)
        return rows

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, and how many each text has; null counts as empty."""
        if not self.splits:
            found = self.model.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)
            n = np.array([len(f.ids) for f in found], np.int64)
            return np.fromiter(chain.from_iterable(f.ids for f in found), self.kind, n.sum()), n
        raw, begin = text_bytes(column)
        starts, chunks = chunk_spans(raw, begin)
        rows = self._rows(raw, starts, np.append(starts[1:], len(raw))) if len(starts) else np.empty(0, np.int32)
        ids, size = self.table.ids(rows)
        return ids, np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(chunks)))])

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null counts as empty."""
        ids, n = self.encode_column(pa.array(list(texts), pa.string()))
        yield from np.split(ids, np.cumsum(n)[:-1]) if len(n) else ()


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(file: str) -> ChunkTable:
    if file not in _TABLES:
        _TABLES[file] = ChunkTable(file)
    return _TABLES[file]


def compress(ids: np.ndarray, last: np.ndarray, vocabulary: int, rounds: int | None = None, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules): symbols from ``vocabulary`` on stand for the two symbols of that rule.

    ``last`` marks the last id of each document and, in the result, its last symbol. Rounds go on until no pair is frequent, unless
    their number is given. After the first one only pairs with a symbol of the round before can be frequent: all others were replaced, or lost a neighbour.
    """
    s, last, rules = ids.astype(np.int64), last.copy(), [np.empty((0, 2), np.int64)]
    known, done = vocabulary, 0
    at = np.arange(max(0, len(s) - 1))
    while len(at) and (rounds is None or done < rounds):
        done += 1
        at = at[~last[at]]
        wide, places = known.bit_length(), len(s).bit_length()
        key = (s[at] << wide) | s[at + 1]
        if 2 * wide + places < 64:  # one sort of pair and place together
            key = np.sort((key << places) | at)
            key, at = key >> places, key & ((1 << places) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        often = count >= frequent
        if not often.any():
            break
        pairs = key[first[often]]
        of = np.full(len(s), -1, np.int32)
        of[at[np.repeat(often, count)]] = np.repeat(np.arange(len(pairs)), count[often])
        # of hits that overlap, every other one, from the left
        where = np.flatnonzero(of >= 0)
        run = np.concatenate(([True], where[1:] != where[:-1] + 1))
        where = where[(where - where[np.flatnonzero(run)][np.cumsum(run) - 1]) % 2 == 0]
        used, code = np.unique(of[where], return_inverse=True)
        rules.append(np.stack((pairs[used] >> wide, pairs[used] & ((1 << wide) - 1)), 1))
        s[where] = known + code
        known += len(used)
        last[where] = last[where + 1]
        keep = np.ones(len(s), bool)
        keep[where + 1] = False
        s, last = s[keep], last[keep]
        new = where - np.arange(len(where))  # a symbol went after each place before
        fresh = np.zeros(len(s), bool)
        fresh[new] = True
        fresh[new[new > 0] - 1] = True
        at = np.flatnonzero(fresh[:-1])
    return s.astype(np.uint32), last, np.concatenate(rules).astype(np.uint32)


def expansions(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Number of ids that each rule stands for; a rule's parts come before it."""
    n = np.zeros(len(rules), np.int64)
    left, right = rules[:, 0].astype(np.int64) - vocabulary, rules[:, 1].astype(np.int64) - vocabulary
    open_ = np.arange(len(rules))
    while len(open_):
        a = np.where(left[open_] < 0, 1, n[np.maximum(left[open_], 0)])
        b = np.where(right[open_] < 0, 1, n[np.maximum(right[open_], 0)])
        ready = (a > 0) & (b > 0)
        n[open_[ready]] = a[ready] + b[ready]
        open_ = open_[~ready]
    return n.astype(np.uint32)


def _width(vocabulary: int, rules: int) -> str:
    return "<u2" if vocabulary + rules <= 1 << 16 else "<u4"


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary: int, rounds: int | None = None, frequent: int = FREQUENT) -> bytes:
    """One shard's file."""
    return pack_shard(doc_ids, np.concatenate(ids) if ids else np.empty(0, np.uint32), np.array([len(i) for i in ids], np.int64), vocabulary, rounds, frequent)


def pack_shard(doc_ids: list[int | None], flat: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int | None = None, frequent: int = FREQUENT) -> bytes:
    """One shard's file, of the ids side by side and how many each document has."""
    ends = np.cumsum(n)
    last = np.zeros(len(flat), bool)
    last[ends[n > 0] - 1] = True
    symbols, last, rules = compress(flat, last, vocabulary, rounds, frequent)
    lengths = expansions(rules, vocabulary)
    symbol_ends = np.zeros(len(n), np.int64)
    symbol_ends[n > 0] = np.flatnonzero(last) + 1
    symbol_ends = np.maximum.accumulate(symbol_ends) if len(n) else symbol_ends
    head = _HEAD.pack(_MAGIC, 2, vocabulary, len(n), len(rules), len(symbols))
    parts = (
        np.array([d is None for d in doc_ids], "u1"),
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.concatenate(([0], symbol_ends)).astype("<u8"),
        np.concatenate(([0], ends)).astype("<u8"),
        rules[:, 0].astype(_width(vocabulary, len(rules))),
        rules[:, 1].astype(_width(vocabulary, len(rules))),
        lengths.astype("<u4"),
        symbols.astype(_width(vocabulary, len(rules))),
    )
    return head + b"".join(p.tobytes() for p in parts)


@dataclass
class Shard:
    """A shard's file, opened."""

    vocabulary: int
    doc_ids: list[int | None]
    symbol_at: np.ndarray
    id_at: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def read(cls, raw: bytes) -> Shard:
        magic, version, vocabulary, docs, rules, symbols = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != 2:
            raise ValueError("not a shard file of this version")
        at, found, w = _HEAD.size, [], _width(vocabulary, rules)
        for kind, n in (("u1", docs), ("<i8", docs), ("<u8", docs + 1), ("<u8", docs + 1), (w, rules), (w, rules), ("<u4", rules), (w, symbols)):
            found.append(np.frombuffer(raw, kind, n, at))
            at += found[-1].nbytes
        doc_ids = [None if null else d for null, d in zip(found[0].tolist(), found[1].tolist(), strict=True)]
        return cls(vocabulary, doc_ids, found[2].astype(np.int64), found[3].astype(np.int64), np.stack((found[4], found[5]), 1), found[6], found[7])

    def _expand_rules(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): every symbol's ids side by side, and where each symbol's are."""
        s, size = np.arange(self.vocabulary, self.vocabulary + len(self.rules)), self.vocabulary
        while (rule := s >= size).any():
            at = np.cumsum(1 + rule) - 1 - rule
            out = np.empty(len(s) + int(rule.sum()), np.int64)
            pairs = self.rules[s[rule] - size]
            out[at[~rule]] = s[~rule]
            out[at[rule]], out[at[rule] + 1] = pairs[:, 0], pairs[:, 1]
            s = out
        length = np.concatenate((np.ones(size, np.int64), self.lengths.astype(np.int64)))
        return np.concatenate((np.arange(size), s)).astype(np.uint32), np.cumsum(length) - length, length

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of some symbols."""
        if self.table is None:
            self.table = self._expand_rules()
        ids, start, length = self.table
        n = length[symbols]
        ends = np.cumsum(n)
        return ids[np.repeat(start[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        """The i-th document's ids, from its own symbols alone."""
        return self.expand(self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]])

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard: only symbols that reach into them are expanded."""
        sizes = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.vocabulary
        sizes[rule] = self.lengths[self.symbols[rule] - self.vocabulary]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        first = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - first : stop - first]


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, shard_ids: int = SHARD_IDS) -> None:
    """Write shards of (doc_id, text) below ``path``: range, shard (its order in the range), n_ids, file.

    Null texts count as empty and have the end id alone; a null doc_id sorts first; rows alike in doc_id
    lie side by side in order of their texts; an empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(public_tokenizers.path(tokenizer))
        part, shard = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        flat, n = np.empty(0, chunks.kind), np.empty(0, np.int64)

        def file(k: int) -> pa.RecordBatch:
            """The first k documents, which go."""
            nonlocal keys, flat, n, shard
            ids = int(n[:k].sum())
            made = pack_shard(keys[:k], flat[:ids], n[:k], chunks.size)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([ids], pa.int64()), pa.array([made], pa.binary())], ["range", "shard", "n_ids", "file"])
            keys, flat, n, shard = keys[k:], flat[ids:], n[k:], shard + 1
            return out

        for batch in batches:
            for some in slices(batch, "text", BYTES_AT_ONCE):
                ids, more = chunks.encode_column(some.column("text"))
                keys += some.column("doc_id").to_pylist()
                flat = np.concatenate((flat, np.insert(ids, np.cumsum(more), END_ID)))
                n = np.concatenate((n, more + 1))
                while (k := int(np.searchsorted(np.cumsum(n), shard_ids)) + 1) <= len(n):
                    yield file(k)
        if keys:
            yield file(len(n))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "range int, shard long, n_ids long, file binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the shards below ``path``: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    files = spark.read.parquet(path)
    totals = {r["range"]: r["n"] for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}  # a number a range
    before, offsets = 0, []
    for k in sorted(totals):
        offsets.append((k, before))
        before += totals[k]
    from pyspark.sql import Window

    inside = F.sum("n_ids").over(Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = files.select("range", "shard", "n_ids").withColumn("inside", F.coalesce(inside, F.lit(0)))
    known = spark.createDataFrame(offsets or [(-1, 0)], "range int, base long")
    placed = sizes.join(F.broadcast(known), "range").select("range", "shard", (F.col("base") + F.col("inside")).alias("base"))
    schema = "doc_id long, range int, shard long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for range_, number, file in zip(*(batch.column(c).to_pylist() for c in ("range", "shard", "file")), strict=True):
                shard = Shard.read(file)
                flat = shard.expand(shard.symbols)
                at = shard.id_at.tolist()
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
                n = len(crc)
                columns = [
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array([range_] * n, pa.int32()),
                    pa.array([number] * n, pa.int64()),
                    pa.array(at[:-1], pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    found = files.select("range", "shard", "file").mapInArrow(run, schema)
    placed = F.broadcast(placed) if files.limit(500_001).count() <= 500_000 else placed
    out = found.join(placed, ["range", "shard"]).withColumn("start", F.col("base") + F.col("start"))
    return out.drop("base", "range", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to files in the shared folder, and read back from them."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/re-pair-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_ids(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
