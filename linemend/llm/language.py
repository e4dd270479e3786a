"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of one to three characters come from all training documents, added up in each task and
then over the tasks: one row for each language and block of buckets. The matrix of log
probabilities has `2 ** BITS` columns and a row per language, so its size is known before it is
broadcast. Scoring adds up the entries of the n-grams that a text holds, in numpy, for whole
batches.

Nulls: a null text, or one without a letter, is `und` with score 0, and so is every text where
nothing could be learned. Rows without language don't train. Repeated rows count as often as they
stand there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

BITS = 14
#: Languages of one broadcast: 16,384 columns of four bytes each are 16 MB.
BLOCK = 256
#: Code points that may be letters; there are none behind the ideographs of the third plane.
POINTS = 0x32400
UNKNOWN = "und"
#: What a bucket has seen besides what was counted.
SMOOTHING = 0.5
#: N-grams of a text are not independent: evidence counts by this part in the score.
TEMPER = 0.2


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: letter or not, lower case; digits, marks and blanks become one blank."""
    n = POINTS
    letter = np.zeros(n, bool)
    lower = np.full(n, 32, np.uint32)
    for c in range(n):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            letter[c] = True
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(s)[0] == "M":
            lower[c] = c
    return letter, lower


def _characters(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case without doubled blanks, offsets, letters in each text)."""
    letter, lower = _tables()
    data, offsets = text.text_bytes(column)
    heads = (data & 0xC0) != 0x80
    places = np.concatenate(([0], np.cumsum(heads)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    known = np.minimum(points, len(lower) - 1)
    is_letter = letter[known]
    low = np.where(points < len(lower), lower[known], points)
    letters = np.concatenate(([0], np.cumsum(is_letter)))
    keep = (low != 32) | (np.concatenate(([0], low[:-1])) != 32) if len(low) else np.zeros(0, bool)
    if len(low):
        keep[np.unique(np.minimum(places[:-1], len(low) - 1))] = True
    size = np.concatenate(([0], np.cumsum(keep)))
    return low[keep], size[places], letters[places[1:]] - letters[places[:-1]]


def _buckets(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of 1, 2 and 3 characters."""
    doc = text.owners(bounds).astype(np.int32)
    shift = np.uint32(32 - BITS)
    docs, out = [], []
    code = np.zeros(len(points), np.uint32)
    for k in (1, 2, 3):
        code = (code[:-1] if k > 1 else code) * np.uint32(0x01000193) + (points[k - 1 :] + np.uint32(k)) * np.uint32(0x9E3779B1)
        whole = doc[: len(code)] == doc[k - 1 :]
        h = code ^ (code >> np.uint32(15))
        docs.append(doc[: len(code)][whole])
        out.append(((h * np.uint32(0x85EBCA6B)) >> shift)[whole])
    return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def gram_counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n_docs, counts array): what all training documents hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                points, bounds, _ = _characters(part.column(0))
                langs = np.array(part.column(1).to_pylist(), object)
                docs, buckets = _buckets(points, bounds)
                names, code = np.unique(langs.astype(str), return_inverse=True)
                flat = np.bincount(code[docs] * (1 << BITS) + buckets, minlength=len(names) << BITS)
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + flat[i << BITS : (i + 1) << BITS]
                    n_docs[name] = n_docs.get(name, 0) + int((code == i).sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.string()),
                pa.array([n_docs[k] for k in sums], pa.int64()),
                pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary()),
            ],
            ["lang", "n_docs", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<i8") for b in text.binaries(table["counts"]))
        return pa.table(
            {
                "lang": table["lang"][:1],
                "n_docs": pa.array([int(text.longs(table["n_docs"]).sum())], pa.int64()),
                "counts": pa.array([total.tobytes()], pa.binary()),
            }
        )

    schema = "lang string, n_docs long, counts binary"
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null").mapInArrow(count, schema)
    # First within salted groups, so that one language does not bring the rows of all tasks to one.
    salted = rows.withColumn("salt", F.spark_partition_id() % 16)

    def add_salted(table: pa.Table) -> pa.Table:
        return add(table)

    return salted.groupBy("lang", "salt").applyInArrow(add_salted, schema).groupBy("lang").applyInArrow(add_salted, schema)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities: one row of buckets for each)."""
    rows = sorted(gram_counts(train, text_col, lang_col).collect(), key=lambda r: r["lang"])
    seen = np.array([np.frombuffer(r["counts"], "<i8") for r in rows], np.float64).reshape(len(rows), 1 << BITS) + SMOOTHING
    return [r["lang"] for r in rows], np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keys: dict[str, Column] | None = None) -> DataFrame:
    """`keys` of each document, lang_pred and score."""
    keys = keys or {}
    names = list(keys)
    source = docs.select(*(c.alias(name) for name, c in keys.items()), F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["lang_pred string", "score double"])
    langs, matrix = model
    shared = [docs.sparkSession.sparkContext.broadcast(matrix[at : at + BLOCK]) for at in range(0, len(langs), BLOCK)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                points, bounds, letters = _characters(part.column(len(names)))
                n = part.num_rows
                best, top = np.full(n, len(langs)), np.zeros(n)
                if langs:
                    docs_of, buckets = _buckets(points, bounds)
                    size = np.maximum(np.sqrt(np.diff(bounds)), 1.0)
                    first, most, total = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n)
                    # Block by block: the best language so far, and the sum of all relative to it.
                    for i, rows in enumerate(shared):
                        logs = np.stack([np.bincount(docs_of, row[buckets], n) for row in rows.value], axis=1)
                        here = logs.max(axis=1)
                        higher = np.maximum(most, here)
                        total *= np.where(most > -np.inf, np.exp(TEMPER * (most - higher) / size), 0.0)
                        total += np.exp(TEMPER * (logs - higher[:, None]) / size[:, None]).sum(axis=1)
                        first = np.where(here > most, i * BLOCK + logs.argmax(axis=1), first)
                        most = higher
                    best = np.where(letters > 0, first, len(langs))
                    top = np.where(letters > 0, 1 / total, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(names))] + [pa.array(labels[best].tolist(), pa.string()), pa.array(top, pa.float64())],
                    [*names, "lang_pred", "score"],
                )

    return source.mapInArrow(score, schema)
