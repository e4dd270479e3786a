"""Alignment of the tokens that two tokenizers cut from the same text.

1. Encode. A reads " " + text byte by byte, B reads the text and adds the space itself. Token bytes come from
   the two vocabularies. A text counts only where both sides join to " " + text.
2. Interval coalescing. Tokens of A and B are byte intervals. All of a batch are sorted by start with one
   lexsort, the ends are accumulated to their running maximum, and a group breaks where a start reaches it.
   Within groups the overlapping pairs of an A and a B token are expanded; those that end together are links.
3. Counts. A link's id pair is counted over the corpus with partial sums. The shorter token of a linked
   pair is a suffix of the longer one, so the vocabularies alone bound the number of different pairs:
   each token has fewer suffixes than bytes, and few ids share the same bytes. Counts are broadcast.
4. Sums. Links, written once with what else is known of a document, are looked up in the counts.

Cases: a null or empty text, and one whose tokens do not join to it (a byte order that B normalises, the
sign that B writes for a space), has no tokens: zeros and an empty digest. Ids pass through as they are, null
and repeated ones too; every row counts. Without documents the result is empty. A text is encoded as
a whole, however long it is. Only the two columns named are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import work_dir
from .batches import per_text, slices
from .text import text_bytes
from .tokens import _byte_letters

#: Fixed values of these vocabularies: how byte-level ones cut a text, the sign for a space, single bytes.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_SIGN = "▁"
#: Runs that the compiled cutter would track back through; the tokenizer's own cutter takes them.
LONG_RUN = re.compile(r"\s{5000}")
#: Text bytes worked on at once (some 60 bytes of numbers for each), strings joined at once.
SLICE_BYTES = 1 << 20
JOINED = 1 << 16
NONE = np.zeros(0, np.int32)


@dataclass(frozen=True)
class Pieces:
    """Byte strings by number, in one array."""

    data: np.ndarray
    size: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(strings: list[bytes]) -> Pieces:
        size = np.array([len(s) for s in strings], np.int64)
        return Pieces(np.frombuffer(b"".join(strings), np.uint8), size, np.cumsum(size) - size)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        """The strings of the numbers, one after the other."""
        out, to = np.empty(int(self.size[numbers].sum()), np.uint8), 0
        for at in range(0, len(numbers), JOINED):
            some = numbers[at : at + JOINED]
            size = self.size[some]
            place = np.cumsum(size)
            n = int(place[-1])
            out[to : to + n] = self.data[np.arange(n) + np.repeat(self.first[some] - (place - size), size)]
            to += n
        return out


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library, by path.

    Merges of the file are ordered as their ids are, so ranks tell the same merges; where a file is
    otherwise, and for long runs of white space, the library itself encodes.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        special = {str(token) for token in self.tokenizer.get_added_tokens_decoder().values()}
        special |= {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.strings = [b""] * (max(model["vocab"].values()) + 1)
        ranks = {}
        for token, number in model["vocab"].items():
            if token in special:
                self.strings[number] = token.encode()
            else:
                ranks[bytes(letters[c] for c in token)] = number
                self.strings[number] = bytes(letters[c] for c in token)
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        self.fast = tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return self.fast.encode_to_numpy(text).astype(np.int32)


class PieceLevel:
    """A sentencepiece model, by path; it adds the space ahead of a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.strings = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int32)


@cache
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, PieceLevel, Pieces, Pieces, Pieces]:
    """(A, B, token bytes of each, and ids as decimals before ',' ';' '|'), one set a worker."""
    a, b = ByteLevel(path_a), PieceLevel(path_b)
    decimals = [f"{number}{sign}".encode() for number in range(max(len(a.strings), len(b.strings))) for sign in ",;|"]
    return a, b, Pieces.of(a.strings), Pieces.of(b.strings), Pieces.of(decimals)


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by start, then side; number of the group of each interval in that order)."""
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    return order, np.cumsum(breaks) - 1


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) places of all pairs whose intervals share a byte; both sides are gapless and in order."""
    low, high = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    n = high - low
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) + np.repeat(low - (np.cumsum(n) - n), n)


class Aligned:
    """The tokens, groups and links of a batch of texts, with bounds by text."""

    def __init__(self, column, path_a: str, path_b: str):
        a, b, bytes_a, bytes_b, self.decimals = tokenizers(path_a, path_b)
        data, offsets = text_bytes(column)
        size = np.diff(offsets)
        texts = [t or "" for t in column.to_pylist()]
        sides = [[a.encode(f" {t}") if t else NONE for t in texts], [b.encode(t) if t else NONE for t in texts]]
        # What both sides must join to, one space ahead of each text that is not empty.
        want = size + (size > 0)
        ends = np.cumsum(want)
        spaced = np.full(int(want.sum()), 0x20, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.cumsum(size > 0), size)] = data
        self.ids, self.bounds, self.size = [], [], []
        good = size > 0
        for ids, pieces in zip(sides, (bytes_a, bytes_b), strict=True):
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate([NONE, *ids]).astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(count)))
            length = per_text(pieces.size[flat], bounds)
            same = length == want
            mine, theirs = np.repeat(same, length), np.repeat(same, want)
            differ = pieces.joined(flat)[mine] != spaced[theirs]
            agree = per_text(differ, np.concatenate(([0], np.cumsum(want * same)))) == 0
            good &= same & agree
            self.ids.append(flat)
            self.bounds.append(bounds)
        starts, stops, texts_of = [], [], []
        for i, pieces in enumerate((bytes_a, bytes_b)):
            count = np.diff(self.bounds[i])
            kept = np.repeat(good, count)
            self.ids[i] = self.ids[i][kept]
            self.bounds[i] = np.concatenate(([0], np.cumsum(count * good)))
            stop = np.cumsum(pieces.size[self.ids[i]])
            starts.append(stop - pieces.size[self.ids[i]])
            stops.append(stop)
            texts_of.append(np.repeat(np.arange(len(good)), count * good))
        self.good, self.starts, self.ends, self.texts_of = good, starts, stops, texts_of
        self.n_texts = len(good)
        # Good texts stand one after the other without gaps, so no token reaches over their ends.
        self.at = np.concatenate(([0], np.cumsum(want * good)))
        self.side = np.repeat([0, 1], [len(self.ids[0]), len(self.ids[1])])
        self.order, self.group = coalesce(np.concatenate(starts), np.concatenate(stops), self.side)
        pair_a, pair_b = overlaps(starts[0], stops[0], starts[1], stops[1])
        together = stops[0][pair_a] == stops[1][pair_b]
        self.link_a, self.link_b = pair_a[together], pair_b[together]

    def counts(self) -> dict[str, np.ndarray]:
        """Tokens, groups and links of each text."""
        text_of = np.concatenate(self.texts_of)[self.order]
        first = np.ones(len(self.group), bool)
        first[1:] = self.group[1:] != self.group[:-1]
        return {
            "n_a": np.diff(self.bounds[0]),
            "n_b": np.diff(self.bounds[1]),
            "n_groups": np.bincount(text_of[first], minlength=self.n_texts),
            "n_links": np.bincount(self.texts_of[0][self.link_a], minlength=self.n_texts),
        }

    def groups(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` for each text: the ids of each group, A's before B's."""
        side = self.side[self.order]
        by_group = np.lexsort((side, self.group))
        side, group = side[by_group], self.group[by_group]
        ids = np.concatenate(self.ids)[self.order][by_group]
        sign = np.zeros(len(ids), np.int64)
        sign[:-1][side[:-1] < side[1:]] = 2
        sign[:-1][group[:-1] < group[1:]] = 1
        numbers = ids * 3 + sign
        written = self.decimals.joined(numbers).tobytes()
        text_of = np.concatenate(self.texts_of)[self.order][by_group]
        size = per_text(self.decimals.size[numbers], np.searchsorted(text_of, np.arange(self.n_texts + 1)))
        ends = np.cumsum(size)
        # The sign behind the last id of a text is no part of it.
        return [written[e - n : e - 1] if n else b"" for e, n in zip(ends.tolist(), size.tolist(), strict=True)]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(byte of " " + text at which each group ends, n + 1 bounds of the texts' groups)."""
        last = np.ones(len(self.group), bool)
        last[:-1] = self.group[1:] != self.group[:-1]
        reached = np.maximum.accumulate(np.concatenate(self.ends)[self.order]) if len(self.order) else np.zeros(0, np.int64)
        text_of = np.concatenate(self.texts_of)[self.order][last]
        return reached[last] - self.at[text_of], np.searchsorted(text_of, np.arange(self.n_texts + 1))


ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, links) of every document.

    `links` holds a number for each linked id pair, A's id times the size of B's vocabulary plus B's id.
    With `spans` also `groups` (the ids of all groups as text) and `group_ends` (bytes of " " + text).
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES):
            found = Aligned(batch.column("text"), path_a, path_b)
            numbers = found.counts()
            groups = found.groups()
            pairs = found.ids[0][found.link_a] * len(tokenizers(path_a, path_b)[1].strings) + found.ids[1][found.link_b]
            bounds = np.concatenate(([0], np.cumsum(numbers["n_links"])))
            columns = {"id": batch.column("id")} | {name: pa.array(n.astype(np.int64)) for name, n in numbers.items()}
            columns["groups_sha256"] = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())
            columns["links"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pairs))
            if spans:
                ends, of = found.spans()
                columns["groups"] = pa.array([g.decode() for g in groups], pa.string())
                columns["group_ends"] = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(ends))
            yield pa.RecordBatch.from_pydict(columns)

    schema = ALIGNED + (", groups string, group_ends array<long>" if spans else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each id pair."""
    return aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def judge(aligned: DataFrame, counts: DataFrame, size_b: int) -> DataFrame:
    """`aligned` with n_best and count_sum instead of links; `counts` has a row for each linked id pair."""
    table = counts.toArrow()
    pair, n = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    highest = np.zeros(size_b, np.int64)
    np.maximum.at(highest, pair % size_b, n)
    held = aligned.sparkSession.sparkContext.broadcast((pair, n, n == highest[pair % size_b]))
    others = [c for c in aligned.columns if c != "links"]

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counted, best = held.value
        for batch in batches:
            links = batch.column("links")
            bounds = np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            at = np.searchsorted(pairs, links.flatten().to_numpy(zero_copy_only=False))
            columns = {c: batch.column(c) for c in others}
            columns["n_best"] = pa.array(per_text(best[at], bounds))
            columns["count_sum"] = pa.array(per_text(counted[at], bounds))
            yield pa.RecordBatch.from_pydict(columns)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in others]
    return aligned.mapInArrow(look_up, ", ".join([*fields, "n_best long", "count_sum long"]))


def compare(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """The rows of `judge` for all documents; what `align` finds is written once below the shared folder."""
    spark = docs.sparkSession
    path = work_dir(spark, "aligned")
    align(docs, path_a, path_b, id_col, text_col, spans).write.parquet(path)
    aligned = spark.read.parquet(path)
    return judge(aligned, pair_counts(aligned), PieceLevel(path_b).model.get_piece_size())
