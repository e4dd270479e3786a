"""Benchmark decontamination by SimHash of item-sized windows. DataFrame and SQL functions only.

1. Probe. Shingles of five words (A-Z in lower case; an item of fewer words is one shingle) of all
   documents, at every word, against the shingles of the items. A window can only resemble an
   item if it holds one of its shingles, so all other windows are left out here, losing none.
2. Fingerprint. Around each hit, every window of the size of an item that has this shingle gets a
   64-bit SimHash of its words, as do the items.
3. Multi-index. A fingerprint is cut into 8 blocks of 8 bits. Items stand in the index with each
   block as it is and with each of its bits turned. Two fingerprints that differ in at most 15 bits
   have a block in which at most one differs, so a join on (size, block, value) finds them all.
4. Verify. Exact weighted Jaccard similarity of the shingles: a shingle weighs as much as it occurs.

Only documents with hits are read for steps 2 to 4. Nothing is gathered by document beyond its own
hits, and a document or item of any frequency is spread over its rows. The item shingles are
broadcast only if they are at most `BROADCAST_ROWS`; beyond that the join is dealt out by shingle.

Nulls: a null or empty text, of a document or an item, is never part of a leak. Equal rows are
judged alike. With empty tables there are no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import free_name

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS = 8, 8
RADIUS = 2 * BLOCKS - 1
#: Rows of 16 bytes.
BROADCAST_ROWS = 1 << 20
#: Words of a window that can be counted in 16 bits of signed longs; longer ones are counted in 32.
LANE_MAX = (1 << 15) - 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles(tokens: Column, k: int = SHINGLE) -> Column:
    """Hashes of every k words in a row; none where there are fewer."""
    at = F.sequence(F.lit(1), F.size(tokens) - (k - 1))
    return F.when(F.size(tokens) >= k, F.transform(at, lambda i: F.xxhash64(F.slice(tokens, i, k)))).otherwise(F.array().cast("array<bigint>"))


def counted(hashes: Column) -> Column:
    """Distinct values for a multiset: the n-th occurrence is told from the first."""

    def nth(x: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(hashes, F.lit(1), i + 1), lambda y: y == x))
        return F.when(n == 1, x).otherwise(F.xxhash64(x, n))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(F.transform(hashes, nth))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of word hashes: 16 longs of four 16-bit counters each, then majorities.

    More words than such a counter holds are counted in 32 longs of two counters of 32 bits.
    """
    return F.when(F.size(hashes) <= LANE_MAX, _counted_bits(hashes, 16)).otherwise(_counted_bits(hashes, 32))


def _counted_bits(hashes: Column, width: int) -> Column:
    lanes = F.lit(sum(1 << at for at in range(0, 64, width))).cast("long")
    zero = F.struct(*(F.lit(0).cast("long").alias(f"c{j}") for j in range(width)), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        hashes,
        zero,
        lambda acc, h: F.struct(
            *((acc[f"c{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(lanes)).alias(f"c{j}") for j in range(width)), (acc["n"] + 1).alias("n")
        ),
        lambda acc: _majorities(acc, width),
    )


def _majorities(acc: Column, width: int) -> Column:
    out = F.lit(0).cast("long")
    for j in range(width):
        for lane in range(64 // width):
            count = F.shiftrightunsigned(acc[f"c{j}"], width * lane).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            bit = j + width * lane
            value = 1 << bit if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(count * 2 > acc["n"], F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _block(fingerprint: Column, j: int) -> Column:
    return F.shiftrightunsigned(fingerprint, j * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def item_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, k, hashes, grams, fingerprint) of the items that have words."""
    cut = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    grams = F.when(n >= SHINGLE, shingles(F.col("w"))).otherwise(F.array(F.xxhash64("w")))
    return cut.select(
        "item",
        n.alias("n"),
        F.least(n, F.lit(SHINGLE)).alias("k"),
        counted(grams).alias("grams"),
        grams.alias("probes"),
        simhash(F.transform("w", lambda x: F.xxhash64(x))).alias("fingerprint"),
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, text_hash, item, start, n_words, similarity): the best window of each document and item.

    `start` counts words from 0. `text_hash` is xxhash64 of the text, so rows that share an id are
    told apart.
    """
    items = item_table(benchmark, item_id, item_text)
    short = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]
    probes = items.select(F.explode("probes").alias("gram"), "k", "n").distinct()
    # Window sizes of each shingle; the number of sizes is at most the number of items with it.
    sizes = probes.groupBy("gram", "k").agg(F.collect_set("n").alias("sizes"))
    if items.count() and probes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("w"))
    hits = None
    for k in short or [SHINGLE]:
        found = (
            keyed.select("id", "text_hash", F.posexplode(shingles(F.col("w"), k)).alias("at", "gram"))
            .join(sizes.filter(F.col("k") == k) if len(short) > 1 else sizes, "gram")
            .select("id", "text_hash", F.explode("sizes").alias("n"), "at", F.lit(k).alias("k"))
        )
        hits = found if hits is None else hits.unionByName(found)
    # Places of one document and size; a document's own hits are as many as its words at most.
    places = hits.groupBy("id", "text_hash", "n", "k").agg(F.collect_set("at").alias("at"))

    # The texts go to the hits, their words are cut again there: they are smaller than the words.
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = texts.join(places.withColumnRenamed("id", "hit_id").withColumnRenamed("text_hash", "hit_hash"), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))).withColumn("w", words(F.col("text")))
    last = F.greatest(F.size("w") - F.col("n"), F.lit(0))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "at",
                lambda p: F.sequence(
                    F.least(F.greatest(p + F.col("k") - F.col("n"), F.lit(0)), last), F.least(p, last)
                ),
            )
        )
    )
    windows = (
        found.select("id", "text_hash", "n", "k", "w", F.explode(starts).alias("start"))
        .select("id", "text_hash", "n", "k", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
        .dropDuplicates(["id", "text_hash", "n", "start"])
    )
    printed = windows.withColumn("print", simhash(F.transform("w", lambda x: F.xxhash64(x))))
    probing = printed.select("*", F.explode(F.array(*(F.struct(F.lit(j).alias("block"), _block(F.col("print"), j).alias("value")) for j in range(BLOCKS)))).alias("b")).select(
        "id", "text_hash", "n", "k", "start", "w", "print", "b.block", "b.value"
    )
    turned = [0] + [1 << b for b in range(BLOCK_BITS)]
    index = items.select(
        "item",
        "n",
        "grams",
        "fingerprint",
        F.explode(
            F.array(*(F.struct(F.lit(j).alias("block"), _block(F.col("fingerprint"), j).bitwiseXOR(F.lit(t)).alias("value")) for j in range(BLOCKS) for t in turned))
        ).alias("b"),
    ).select("item", "n", "grams", "fingerprint", "b.block", "b.value")
    near = probing.join(index, ["n", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))) <= RADIUS)
    own = counted(F.when(F.size("w") >= SHINGLE, shingles(F.col("w"))).otherwise(F.array(F.xxhash64("w"))))
    checked = near.select("id", "text_hash", "item", "start", F.size("w").alias("n_words"), "grams", own.alias("own"))
    common = F.size(F.array_intersect("own", "grams"))
    similarity = common / (F.size("own") + F.size("grams") - common)
    best = checked.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold)
    return (
        best.groupBy("id", "text_hash", "item")
        .agg(F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
        .select("id", "text_hash", "item", "best.start", "best.n_words", "best.similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item."""
    id_, hash_ = (free_name(n, docs.columns) for n in ("_leak_id", "_leak_hash"))
    found = leaks(docs, benchmark, id_col, text_col, **names).select(F.col("id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_))
    return docs.join(found, same, "left_anti")
