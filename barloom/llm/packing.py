"""Packing documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import to_python
from barloom.llm.textkernel import U, span_hashes

#: Texts of these characters alone are cut into pieces here; what tokenizers would change or cut otherwise is left to it.
_PLAIN = re.compile("[\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
#: Kinds of bytes of such texts: 0 white space, 1 letters, 2 digits, 3 other marks.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[97:123] = _KIND[65:91] = _KIND[128:] = 1
_KIND[48:58] = 2
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Pieces whose ids a worker keeps, at most; then it starts anew.
_MOST_PIECES = 1_500_000
_RECENT_PIECES = 30_000
_encoders: dict[str, Encoder] = {}


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of plain lower-case texts: runs of letters, single digits, runs of other
    marks; an apostrophe by itself takes s, t, m, d, re, ve or ll from what follows."""
    kind = np.zeros(len(data) + 3, np.uint8)
    kind[:-3] = _KIND[data]
    change = np.ones(len(data) + 3, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= kind == 2
    change[offsets] = True
    mark = np.flatnonzero((data == 39) & change[: len(data)])
    mark = mark[(kind[mark + 1] == 1) & ~np.isin(mark + 1, offsets)]
    if len(mark):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        first, second = padded[mark + 1], np.where(change[mark + 2], 0, padded[mark + 2])
        pair = ((first == 114) & (second == 101)) | ((first == 118) & (second == 101)) | ((first == 108) & (second == 108))
        for taken, n in ((np.isin(first, (115, 116, 109, 100)), 2), (pair, 3)):
            change[mark[taken] + 1] = False
            change[mark[taken] + n] = True
    at = np.flatnonzero(change[: len(data) + 1])
    inside = kind[at[:-1]] != 0
    return at[:-1][inside], at[1:][inside]


class Known:
    """Token ids of pieces by their hashes, in sorted arrays."""

    def __init__(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether each is here)"""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """keys: sorted, none of them here."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    For a tokenizer that lower-cases, cuts as pieces() does and encodes each piece by itself (one whose vocabulary marks
    ends of words). The ids of pieces are kept by 64-bit hash and looked up for all pieces of many texts at
    once; new pieces are encoded together. Other tokenizers, and texts that aren't plain, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id ends a piece
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_piece = bool(self.ends.any())
        self._start_anew()

    def _start_anew(self) -> None:
        self.main, self.recent, self.pool, self.used = Known(), Known(), np.zeros(1 << 16, "<u4"), 0

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_piece and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        coded = [t.lower().encode() if p else b"" for t, p in zip(texts, plain, strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        starts, ends = pieces(data, offsets)
        ids, lengths = self._ids(data, starts, ends)
        after = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)] * 4
        flat = ids.tobytes()
        return [flat[a:b] if p else self._whole(t) for t, p, a, b in zip(texts, plain, after[:-1].tolist(), after[1:].tolist(), strict=True)]

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, how many each has)"""
        keys = span_hashes(data, starts, ends, fold_case=False)
        at, here = self.main.find(keys)
        rest = np.flatnonzero(~here)
        late, there = self.recent.find(keys[rest])
        new = rest[~there]
        if len(new):
            own, first = np.unique(keys[new], return_index=True)
            self._learn(own, [data[starts[k] : ends[k]].tobytes().decode() for k in new[first]])
            late, _ = self.recent.find(keys[rest])
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[here], count[here] = self.main.begin[at[here]], self.main.count[at[here]]
        if len(rest):
            begin[rest], count[rest] = self.recent.begin[late], self.recent.count[late]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(begin - total + count, count) + np.arange(total[-1] if len(total) else 0)]
        if len(self.recent.keys) > _RECENT_PIECES:
            self.main.add(self.recent.keys, self.recent.begin, self.recent.count)
            self.recent = Known()
            if len(self.main.keys) > _MOST_PIECES:
                self._start_anew()
        return ids, count

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        parts = [texts[k : k + 256] for k in range(0, len(texts), 256)]
        found = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)]
        for k, part in enumerate(parts):
            if int(self.ends[found[k]].sum()) != len(part) or not self.ends[found[k][-1]]:
                raise ValueError("this tokenizer cuts words otherwise")
        ids = np.concatenate(found)
        stop = np.flatnonzero(self.ends[ids]) + 1
        begin = np.concatenate([[0], stop[:-1]])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        self.recent.add(keys, begin + self.used, stop - begin)
        self.used += len(ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Packer:
    """Windows of `size` ids, filled online.

    level[h] counts the open windows that hold h ids. A remainder of r ids goes to the open or new
    window for which the sum of level[h]**2 over 0 < h < size grows least; ties to the fullest.
    A full window closes at once, so what is held is the open windows alone.
    """

    def __init__(self, size: int):
        self.size, self.level, self.open, self.closed = size, np.zeros(size + 1, np.int64), {}, []

    def place(self, piece: tuple) -> None:
        """piece: (doc, start, ids, doc_tokens); at most `size` ids."""
        n = len(piece[2]) // 4
        if n == self.size:
            self.closed.append([piece])
            return
        now, then = self.level[: self.size - n + 1], self.level[n:]
        grows = 2 * then + 1
        grows[-1] = 0
        grows -= 2 * now - 1
        grows[now == 0] = np.iinfo(np.int64).max
        grows[0] = 2 * self.level[n] + 1
        h = len(grows) - 1 - int(np.argmin(grows[::-1]))
        window = []
        if h:
            window = self.open[h].pop()
            self.level[h] -= 1
        window.append(piece)
        if h + n == self.size:
            self.closed.append(window)
        else:
            self.open.setdefault(h + n, []).append(window)
            self.level[h + n] += 1

    def settle(self) -> None:
        """Closes all: the emptiest open windows are cut up to fill the fullest, and the last one
        is cut into powers of two, which need no padding."""
        left = [w for h in sorted(self.open) for w in self.open[h]]
        rest: list[tuple] = []
        while left or rest:
            window = left.pop() if left else []
            room = self.size - sum(len(p[2]) // 4 for p in window)
            while room and (rest or left):
                if not rest:
                    rest = left.pop(0)
                take, keep = _cut(rest.pop(), room)
                window.append(take)
                rest += [keep] if keep else []
                room -= len(take[2]) // 4
            if not room:
                self.closed.append(window)
                continue
            total = self.size - room
            while total:
                part = 1 << (total.bit_length() - 1)
                total -= part
                piece: list[tuple] = []
                while part:
                    take, keep = _cut(window.pop(0), part)
                    piece.append(take)
                    window[:0] = [keep] if keep else []
                    part -= len(take[2]) // 4
                self.closed.append(piece)
        self.open, self.level = {}, np.zeros(self.size + 1, np.int64)


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
    doc, start, ids, tokens = piece
    if len(ids) <= 4 * n:
        return piece, None
    return (doc, start, ids[: 4 * n], tokens), (doc, start + n, ids[4 * n :], tokens)


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs `docs` (doc_id, text) into windows of `size` token ids.

    Each input partition packs its own rows in one pass, without a shuffle, holding only its open
    windows, and leaves at most one window unfilled, which becomes sequences of powers of two. A lost
    task repeats with the same result. tokenizer_path: where the tokenizer's file lies on every
    executor; by default that of public_tokenizers' word_bpe_49k.json.

    Returns a row for each piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset. Null text: only end_id. Null ids and repeated rows are packed as rows of
    their own. No rows: none. Other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in _encoders:  # kept while the worker lives
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        packer, end, sequence = Packer(size), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            if len(packer.closed) < least:
                return
            out = []
            for window in packer.closed:
                offset = 0
                for doc, start, ids, tokens in window:
                    out.append((doc, start, len(ids) // 4, bytes(ids), tokens, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            packer.closed = []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

        def place(docs: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            for doc, found in zip(docs, encoder.encode(texts), strict=True):
                ids = found + end
                tokens = len(ids) // 4
                for start in range(0, tokens, size):
                    packer.place((doc, start, ids[4 * start : 4 * (start + size)], tokens))
            yield from rows(1000)

        for batch in batches:
            docs, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= 1 << 19:
                    yield from place(docs, texts)
                    docs, texts, held = [], [], 0
            yield from place(docs, texts)
        packer.settle()
        yield from rows(1)

    return to_python(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
