"""SentencePiece encoding and decoding through one table of distinct marked words.

No piece of the model holds a whitespace marker after another character (checked when it is loaded), so no merge
crosses the gap before a marker: a text is its marked words one after the other, each a run of markers with the characters up
to the next one. The table of distinct marked words is built and used by exchanges, and nothing of it is broadcast:

1. Each scan task cuts its rows into blocks of about ``BLOCK_BYTES`` of text. A block's words become places in the list of its distinct words.
2. The distinct words of all blocks are dealt by their digest, so that all blocks' copies of a word come to one task, which segments it once, by the library.
3. The ids go back to the blocks that hold the word, and each document's places become ids and text again.

So words are joined back by position inside a block, and what is exchanged is one packed list for each block and task instead of a row for each word; a
frequent word counts once a block. Texts that hold the marker character itself, and any text under a model
whose pieces can cross markers, are one word each that the library encodes whole.

Blocks are cut in two scans, which must read the same rows in the same order, as scans of files do; a block's name holds a digest of its words, and where
the scans differ the job fails instead of giving other results.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import IdTable, digests, slices, text_bytes
from ._common import releasing, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
BLOCK_BYTES = 8 << 20  # text of a block: what one task holds at a time
TABLE_WORDS = 1_000_000  # words that a task keeps of those it segmented: a bound on memory that costs time alone
_MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)


@dataclass
class Words:
    """The distinct words of some texts, the most frequent first, and each text's words as places in that list.

    ``whole`` marks entries that are texts to be encoded whole; ``n`` counts the words of each text.
    """

    words: pa.Array
    digest: np.ndarray
    whole: np.ndarray
    places: np.ndarray
    n: np.ndarray


def word_spans(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each marked word without its first marker, and how many each text has.

    A run of blanks belongs to the word after it, and its first blank is the marker; a text's start has a marker of its own.
    """
    edge = np.zeros(len(raw) + 1, bool)
    edge[begin] = True
    blank = raw == 32
    first = np.flatnonzero(blank)
    first = first[~edge[first]]
    first = first[~blank[first - 1]]
    heads = begin[:-1][begin[1:] > begin[:-1]]
    at = np.sort(np.concatenate((heads, first)))
    starts = at + ~edge[at]
    return starts, np.append(at[1:], len(raw)), np.diff(np.searchsorted(at, begin))


def cut_words(column: pa.Array, splits: bool = True) -> Words:
    """Words of the texts of a column; null counts as empty and has none."""
    raw, begin = text_bytes(column)
    odd = np.arange(len(column)) if not splits else _marked(raw, begin)
    odd = odd[begin[odd + 1] > begin[odd]]
    starts, ends, n = word_spans(raw, begin)
    h = digests(raw, starts, ends)
    whole = np.zeros(len(h), bool)
    if len(odd):
        # the words of a text that is encoded whole give way to one entry
        first = np.concatenate(([0], np.cumsum(n)))
        gone = np.zeros(len(h), bool)
        for i in odd.tolist():
            gone[first[i] + 1 : first[i + 1]] = True
        lead = first[odd]
        starts[lead], ends[lead], whole[lead] = begin[odd], begin[odd + 1], True
        h[lead] = ~digests(raw, begin[odd], begin[odd + 1])
        starts, ends, h, whole = (x[~gone] for x in (starts, ends, h, whole))
        n[odd] = 1
    digest, at, places, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = at[order]
    return Words(_spelled(raw, starts[at], ends[at]), digest[order], whole[at], rank[places], n)


def _marked(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Texts that hold the marker character."""
    at = np.flatnonzero(raw[: max(0, len(raw) - 2)] == _MARK_BYTES[0])
    at = at[(raw[at + 1] == _MARK_BYTES[1]) & (raw[at + 2] == _MARK_BYTES[2])]
    return np.unique(np.searchsorted(begin, at, "right") - 1)


def _spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    body = raw.tobytes()
    return pa.array([body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


class Segmenter:
    """Segments words by the library."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.decode(self.model.encode("a  b  ﬁ")) == "a  b  ﬁ"
        # a trailing marker alone is the empty word, which the library does not encode by itself
        self.last_mark = [self.model.piece_to_id(MARK)]
        self.surface = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.surfaces = pa.array(self.surface, pa.binary())
        self.decimal = pa.array([f"{i}," for i in range(len(pieces))], pa.binary())

    def segment(self, words: list[str]) -> tuple[list[list[int]], dict[int, bytes]]:
        """Ids of each word, and what they decode to where that is not the surfaces of the pieces behind a blank."""
        ids = self.model.encode(words, num_threads=1) if words else []
        back = self.model.decode(ids, num_threads=1) if ids else []
        odd = {}
        for i, (w, found, b) in enumerate(zip(words, ids, back, strict=True)):
            if not w:
                ids[i], b = list(self.last_mark), ""
            if b != w or b"".join([self.surface[j] for j in ids[i]]) != b" " + w.encode():
                odd[i] = b.encode()
        return ids, odd

    def ids_of(self, table: IdTable, odd: dict[int, bytes], words: pa.Array, digest: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
        """Ids of distinct words side by side, how many each has, and the odd ones' text by place.

        ``table`` and ``odd`` (by digest) learn words that are new; entries marked ``whole`` are texts, which the library encodes as they are.
        """
        rows = table.find(digest)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            if table.make_room(len(missing)):
                left = set(table.keys[: table.n].tolist())
                for key in [k for k in odd if k not in left]:
                    del odd[key]
                rows = table.find(digest)
                missing = np.flatnonzero(rows < 0)
            ids, strange = self.segment([w.decode() for w in words.take(pa.array(missing)).to_pylist()])
            for i in np.flatnonzero(whole[missing]).tolist():
                text = words[missing[i]].as_py().decode()
                ids[i] = self.model.encode(text)
                strange[i] = self.model.decode(ids[i]).encode()
            table.add(digest[missing], np.fromiter(chain.from_iterable(ids), table.kind), np.fromiter(map(len, ids), np.int64, len(ids)))
            odd |= {int(digest[missing[i]]): b for i, b in strange.items()}
            table.mark(rows[rows >= 0])
            rows[missing] = table.find(digest[missing])
        else:
            table.mark(rows)
        at = {i: odd[k] for i, k in enumerate(digest.tolist()) if k in odd} if odd else {}
        return *table.ids(rows), at


def assemble(one: Segmenter, places: np.ndarray, n: np.ndarray, ids: np.ndarray, size: np.ndarray, odd: dict[int, bytes]) -> Iterator[tuple[bytes, np.ndarray, bytes]]:
    """(decimal ids each with a comma, ids, decoded text) of each text, from its words' places and the listed words' ids."""
    first = np.concatenate(([0], np.cumsum(size)))
    spelled, text = (_joined(x.take(pa.array(ids)), first) for x in (one.decimal, one.surfaces))
    if odd:
        text = pa.array([b" " + odd[k] if k in odd else b for k, b in enumerate(text.to_pylist())], pa.large_binary())
    at = 0
    for k in n.tolist():
        mine = places[at : at + k]
        at += k
        some = pa.array(mine)
        yield _body(spelled.take(some)), ids[_runs(first[mine], size[mine])], _body(text.take(some))[1:]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _joined(values: pa.Array, first: np.ndarray) -> pa.Array:
    """Runs of binary values made one value each."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1] if len(values) else np.zeros(1, np.int32)
    made = offsets[first].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(made), values.buffers()[2] if len(values) else pa.py_buffer(b"")])


def _body(values: pa.Array) -> bytes:
    """All values of a freshly taken binary array, one after the other."""
    return (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: int(np.frombuffer(values.buffers()[1], np.int64)[len(values)])] if len(values) else b""


class PieceTable(Segmenter):
    """Encodes texts as the library does, word by word, in one process."""

    def __init__(self, model_file: str):
        super().__init__(model_file)
        self.table, self.odd = IdTable(TABLE_WORDS), {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[str, int, str]]:
        """(decimal ids joined by commas, number of ids, decoded text) of each text; null counts as empty."""
        made = cut_words(pa.array(list(texts), pa.string()), self.splits)
        found = self.ids_of(self.table, self.odd, made.words, made.digest, made.whole)
        for spelled, ids, text in assemble(self, made.places, made.n, *found):
            yield spelled[:-1].decode(), len(ids), text.decode()


_MADE: dict[str, Segmenter] = {}


def segmenter(model: str) -> Segmenter:
    """This process's segmenter of a model."""
    if model not in _MADE:
        _MADE[model] = Segmenter(public_tokenizers.path(model))
    return _MADE[model]


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32: their bytes in four planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], text: str, splits: bool) -> Iterator[tuple[bytes, pa.RecordBatch, Words]]:
    """(name, rows, words) of each block of a partition."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for some in slices(batch, text, BLOCK_BYTES):
            made = cut_words(some.column(text), splits)
            mark = int(np.bitwise_xor.reduce(made.digest)) if len(made.digest) else 0
            yield struct.pack(">IIQII", part, number, mark, len(made.digest), len(made.places) & 0xFFFFFFFF), some, made
            number += 1


def _encoded(docs: DataFrame, model: str, text: str, finish, schema: str) -> DataFrame:
    """Rows of ``docs`` with what ``finish(rows, texts)`` makes of each block: rows without the text, and (decimals, ids, decoded) of each."""
    others = [c for c in docs.columns if c != text]
    source = docs.select(*others, text)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, some, made in _blocks(batches, text, segmenter(model).splits):
            ends = np.cumsum(made.n).tolist()
            places = pa.array([_pack(made.places[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), pa.array([name] * len(places), pa.binary()), pa.array(np.arange(len(places)), pa.int32()), places], [*others, "__block", "__at", "__places"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "n", "at", "sizes", "whole", "body"]
        for name, _, made in _blocks(batches, text, segmenter(model).splits):
            to = (made.digest % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[p] : cuts[p + 1]]
                mine = made.words.take(pa.array(at))
                sizes = np.diff(np.frombuffer(mine.buffers()[1], np.int32)[: len(mine) + 1])
                body = b"" if mine.buffers()[2] is None else mine.buffers()[2].to_pybytes()[: int(sizes.sum())]
                packed = zstandard.ZstdCompressor(level=1).compress(body)
                out.append((p, name, len(made.digest), _pack(at), _pack(sizes), np.packbits(made.whole[at]).tobytes() if made.whole[at].any() else None, packed))
            kinds = (pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = segmenter(model)
        known, odd = IdTable(TABLE_WORDS), {}
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.concatenate(([0], np.cumsum(_unpack(r["sizes"]).astype(np.int64))))
                body = zstandard.ZstdDecompressor().decompress(r["body"]) if ends[-1] else b""
                spelled = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)])
                digest = digests(np.frombuffer(body, np.uint8), ends[:-1], ends[1:])
                whole = np.zeros(len(digest), bool) if r["whole"] is None else np.unpackbits(np.frombuffer(r["whole"], np.uint8))[: len(digest)].astype(bool)
                digest[whole] = ~digest[whole]
                ids, size, strange = one.ids_of(known, odd, spelled, digest, whole)
                odd_at, odd_text = list(strange), list(strange.values())
                columns = ([r["block"]], [r["n"]], [r["at"]], [_pack(ids)], [_pack(size)], [odd_at], [odd_text])
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["__block", "n", "at", "ids", "sizes", "odd_at", "odd"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("__at")
        listed = right.to_pylist()
        places = [_unpack(p) if p else np.empty(0, np.uint32) for p in left.column("__places").to_pylist()]
        count = np.array([len(p) for p in places], np.int64)
        total = listed[0]["n"] if listed else 0
        at = np.concatenate([_unpack(r["at"]) for r in listed]).astype(np.int64) if listed else np.empty(0, np.int64)
        if len(at) != total or (count.any() and not total):
            raise RuntimeError("the scans of the documents differ: write them to a table first")
        sizes = np.concatenate([_unpack(r["sizes"]) for r in listed]).astype(np.int64) if listed else at
        ids = np.concatenate([_unpack(r["ids"]) for r in listed]).astype(np.int32) if listed else np.empty(0, np.int32)
        odd, base = {}, 0
        for r in listed:
            odd |= {base + i: b for i, b in zip(r["odd_at"], r["odd"], strict=True)}
            base += len(_unpack(r["at"]))
        # entries stand in the order in which they came: places point there
        where = np.empty(total, np.int64)
        where[at] = np.arange(total)
        flat = where[np.concatenate(places)] if count.any() else np.empty(0, np.int64)
        return finish(left.drop_columns(["__block", "__at", "__places"]), assemble(segmenter(model), flat, count, ids, sizes, odd))

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema]
    mine = source.mapInArrow(releasing(rows), ", ".join([*kinds, "__block binary, __at int, __places binary"]))
    asked = source.mapInArrow(releasing(words), "part int, block binary, n long, at binary, sizes binary, whole binary, body binary")
    back = asked.repartitionById(parts, F.col("part")).mapInArrow(releasing(answers), "__block binary, n long, at binary, ids binary, sizes binary, odd_at array<int>, odd array<binary>")
    return mine.groupBy("__block").cogroup(back.groupBy("__block")).applyInArrow(join, schema)


def encode_documents(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, plus ids array<int>, n_tokens long and decoded string.

    Null counts as empty, and an empty text has no ids. No begin or end ids, no sampling. Columns that bear a
    result column's name are replaced. Repeated rows are rows of their own; an empty table gives an empty result.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(text).schema]

    def finish(rows: pa.Table, texts: Iterator[tuple[bytes, np.ndarray, bytes]]) -> pa.Table:
        made = [(ids, back) for _, ids, back in texts]
        n = np.array([len(ids) for ids, _ in made], np.int64)
        flat = np.concatenate([ids for ids, _ in made]) if made else np.empty(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(flat.astype(np.int32)))
        return rows.append_column("ids", ids).append_column("n_tokens", pa.array(n)).append_column("decoded", pa.array([back.decode() for _, back in made], pa.string()))

    return _encoded(docs, model, text, finish, ", ".join([*kinds, "ids array<int>", "n_tokens bigint", "decoded string"]))


def digest_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text: what ``encode_documents`` gives, digested in the worker."""

    def finish(rows: pa.Table, texts: Iterator[tuple[bytes, np.ndarray, bytes]]) -> pa.Table:
        made = [(len(ids), hashlib.sha256(spelled[:-1]).hexdigest(), hashlib.sha256(back).hexdigest()) for spelled, ids, back in texts]
        for i, (name, kind) in enumerate((("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))):
            rows = rows.append_column(name, pa.array([m[i] for m in made], kind))
        return rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _encoded(docs.select("doc_id", "text"), model, "text", finish, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
