"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from barloom.llm.common import summed, to_python
from barloom.llm.textkernel import U, mix

BUCKETS = 1 << 15
_BLOCK = 1 << 11
#: Tasks that count n-grams, at most: each sends a table of BUCKETS cells for each language.
COUNTING_TASKS = 4096
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(texts: list[str], orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, offsets by text, whether each text has letters).

    Letters are lower-cased; everything between them counts as one blank, and a blank stands
    before and after each text.
    """
    lower = [t.lower() for t in texts]
    code = np.frombuffer("".join(f" {t} " for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lower])
    letter = letter_table()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter
    keep |= np.concatenate([[True], text_of[1:] != text_of[:-1]])
    code, text_of = np.where(letter, code, 32)[keep].astype(U), text_of[keep]
    per = np.bincount(text_of, minlength=len(texts))
    buckets, owners = [], []
    for n in orders:
        have = len(code) - n + 1
        if have <= 0:
            continue
        whole = text_of[:have] == text_of[n - 1 :]
        if n == 1:
            whole &= code != 32
        buckets.append(_buckets(code, n)[whole])
        owners.append(text_of[:have][whole])
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    return bucket[order], at, np.bincount(text_of, weights=code != 32, minlength=len(texts)) > 0 if len(per) else np.zeros(0, bool)


#: Characters beyond which a text is worked through in parts.
LONG = 1 << 19


def grams_of_long(text: str, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[np.ndarray]:
    """The buckets of grams([text]), a part of the text at a time."""
    lower, kept, letter_before = text.lower(), [np.array([32], np.uint32)], False
    for low in range(0, len(lower), LONG):
        code = np.frombuffer(lower[low : low + LONG].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letter_table()[code]
        after = np.concatenate([[letter_before], letter[:-1]])
        kept.append(np.where(letter, code, np.uint32(32))[letter | after])
        letter_before = bool(letter[-1])
    code = np.concatenate([*kept, np.full(int(letter_before), 32, np.uint32)])
    for low in range(0, len(code), LONG):
        for n in orders:
            part = code[low : low + LONG + n - 1].astype(U)
            have = len(part) - n + 1
            if have > 0:
                bucket = _buckets(part, n)
                yield bucket[part != 32] if n == 1 else bucket


def _buckets(code: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place."""
    have = len(code) - n + 1
    value = np.full(have, n, U)
    for k in range(n):
        value = value * U(0x100000001B3) + code[k : k + have]
    return (mix(value) >> U(64 - 15)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # (BUCKETS, languages)
    log_prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language (ties: the first by code point) and its probability, tempered by length."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if len(texts) == 1 and len(texts[0]) > LONG:
            n = np.zeros(1, np.int64)
            for bucket in grams_of_long(texts[0]):
                seen = np.bincount(bucket, minlength=BUCKETS)
                total[0] += seen @ self.log_probability.astype(np.float64)
                n += len(bucket)
            lettered = n > 0
        else:
            bucket, at, lettered = grams(texts)
            n = np.diff(at)
            full = np.flatnonzero(n)
            if len(full):
                total[full] = np.add.reduceat(self.log_probability[bucket], at[:-1][full], axis=0)
        total += self.log_prior
        total *= (1 / np.sqrt(np.maximum(n, 1)))[:, None]  # n-grams of a text aren't independent
        best = total.argmax(axis=1)
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if k else "und" for b, k in zip(best, lettered, strict=True)], np.where(lettered, p, 0.0)


def _chunks(texts: pa.Array, most: int = LONG) -> Iterator[tuple[int, list[str]]]:
    """Parts of about `most` characters; a longer text is a part of its own."""
    first, size, part = 0, 0, []
    for k, t in enumerate(texts):
        t = t.as_py() or ""
        if part and size + len(t) > most:
            yield first, part
            first, size, part = k, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def train(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Counts the n-grams of all rows of docs (text, lang), by language, on the executors.

    The driver gets BUCKETS cells for each language, however large docs is; a task holds as many for each language it
    meets, so languages should be some hundreds at most. Rows whose text or lang is null teach nothing. No rows: a model that answers `und`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, texts in _chunks(batch.column(0)):
                own = langs[first : first + len(texts)]
                for lang in dict.fromkeys(own):
                    if lang not in cells:
                        cells[lang] = np.zeros(BUCKETS + _BLOCK)
                    cells[lang][BUCKETS] += (own == lang).sum()
                if len(texts) == 1 and len(texts[0]) > LONG:
                    for bucket in grams_of_long(texts[0]):
                        cells[own[0]][:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    continue
                bucket, at, _ = grams(texts)
                for lang in dict.fromkeys(own):
                    cells[lang][:BUCKETS] += np.bincount(bucket[np.repeat(own == lang, np.diff(at))], minlength=BUCKETS)
        rows = [(lang, b, c[b * _BLOCK : (b + 1) * _BLOCK].tobytes()) for lang, c in cells.items() for b in range(len(c) // _BLOCK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["lang", "block", "cells"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    parts = to_python(rows.coalesce(COUNTING_TASKS), count, "lang string, block int, cells binary")
    found: dict[str, np.ndarray] = {}
    for lang, block, cells in summed(parts, ["lang", "block"]).collect():
        found.setdefault(lang, np.zeros(BUCKETS + _BLOCK))[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(cells)
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    table = np.stack([found[k] for k in languages], axis=1)
    cell = table[:BUCKETS] + smoothing
    return Model(languages, np.log(cell / cell.sum(axis=0)).astype(np.float32), np.log(table[BUCKETS] / table[BUCKETS].sum()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added; docs need a column text.

    Null or empty text and text without a letter: `und`, score 0. Repeated rows stay, each with its
    own result. Columns of docs named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in _chunks(batch.column(batch.schema.get_field_index("text"))):
                lang, score = shared.value.score(texts)
                langs += lang
                scores.append(score)
            made = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score"])

    return to_python(docs.select(*kept), run, schema)


def train_and_identify(docs: DataFrame, learn: Column) -> DataFrame:
    """identify() by a model of the rows of docs for which `learn` holds; the lang column is not read for predictions."""
    return identify(docs, train(docs.where(learn)))
