"""Resampling of documents towards the distribution of a target corpus, by hashed n-grams.

1. Features. A document is normalised to its words, A-Z lower-cased, with one separator between them, and
   scanned once for the CRCs of all its prefixes (`crc`). Each run of `shortest` to `longest` words is a
   feature; its CRC-32 follows from the prefixes at its two ends and, modulo `buckets`, is its bucket.
2. Counts. Every task counts its buckets over all its texts and sends one row a bucket.
3. Gains. A bucket that the target holds more often than the corpus gains, with one more of each feature
   counted: floor(1000 ln ((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). One long a bucket is broadcast.
4. Weights. A document's weight is the sum of the gains of its features; a Gumbel number from the hash of
   its id is added, so that the highest scores are a draw without replacement by exp(weight / 1000).
5. Draw. Documents of `least_words` words and more are dealt by score in ranges, sorted there and written;
   a rank is the place in the range plus the sizes of the ranges before.

Cases: a null or empty text, or one without words, has no features and weight 0. A null id is hashed as an
empty text and comes last among ties. Repeated rows count and are drawn each for itself. Without documents
the result is empty; without target texts all t are 0. Only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir
from . import crc, text
from .batches import per_text, slices

#: Bytes between words once A-Z are lower-cased: ASCII other than digits and letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Features:
    """Which runs of words count, and into how many buckets they fall."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000

    def of(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each feature, n + 1 bounds of the texts' features, n + 1 bounds of their words)."""
        data, offsets = text.text_bytes(column)
        data = text.LOWER[data]
        starts, ends, bounds = text.words(data, offsets, BETWEEN)
        size = ends - starts
        place = np.cumsum(size + 1) - size - 1
        normal = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        normal[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[~BETWEEN[data]]
        prefixes = crc.Prefixes(normal)
        found, owner = [], []
        for n in range(self.shortest, self.longest + 1):
            first = text.gram_starts(bounds, n)
            last = first + n - 1
            found.append(prefixes.spans(place[first], place[last] + size[last]) % np.uint32(self.buckets))
            owner.append(np.searchsorted(bounds, first, "right") - 1)
        buckets, owner = np.concatenate(found).astype(np.int64), np.concatenate(owner)
        if self.shortest != self.longest:
            buckets = buckets[np.argsort(owner, kind="stable")]
        return buckets, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1)))), bounds


def bucket_counts(docs: DataFrame, text_col: str = "text", features: Features = Features()) -> DataFrame:
    """(bucket, n): features of all texts, for the buckets that occur."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(features.of(batch.column("text"))[0], minlength=features.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, features: Features = Features()) -> np.ndarray:
    """One long a bucket, from two tables of `bucket_counts` (at most `buckets` rows each)."""
    s, t = np.zeros(features.buckets), np.zeros(features.buckets)
    for counts, counted in ((s, corpus), (t, target)):
        for bucket, n in counted.collect():
            counts[bucket] = n
    ratio = (t + 1) * (s.sum() + features.buckets) / ((s + 1) * (t.sum() + features.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", features: Features = Features()) -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buckets, bounds, words = features.of(batch.column("text"))
            columns = [batch.column("id"), pa.array(np.diff(words)), pa.array(np.diff(bounds)), pa.array(per_text(held.value[buckets], bounds))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        weights, "id long, n_words long, n_features long, weight long"
    )


def gumbel(id_: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): rank 1, 2, 3, ... of the drawn documents, else null.

    Of the N documents with enough words, floor(percent N / 100) are drawn. A table of numbers is written
    twice below the shared folder: once as weighed, once in the order of the ranks.
    """
    spark = weighed.sparkSession
    path = work_dir(spark, "weighed")
    weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).write.parquet(path)
    scored = spark.read.parquet(path)
    enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("id")]
    # The last key splits rows that are alike in score and id.
    ranges = scored.filter(enough).withColumn("spread", F.monotonically_increasing_id())
    dealt = ranges.repartitionByRange(*order, F.asc("spread")).sortWithinPartitions(*order, F.asc("spread")).drop("spread")
    path = work_dir(spark, "ranked")
    dealt.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    # The number of the task stands above bit 33, the number of the row in it below.
    placed = spark.read.parquet(path).withColumn("task", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    drawn = percent * scored.filter(enough).count() // 100
    rank = F.col("start") + F.col("place") + 1
    ranked = placed.join(starts, "task").withColumn("rank", F.when(rank <= drawn, rank)).drop("task", "place", "start")
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    features: Features = Features(), percent: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """The rows of `draw` for all documents, weighed towards the texts of `target`."""
    gain = gains(bucket_counts(docs, text_col, features), bucket_counts(target, target_col, features), features)
    return draw(weigh(docs, gain, id_col, text_col, features), percent, least_words, seed)
