"""Exact top-k by inner product with segment statistics at several resolutions.

A vector is cut into segments. With means m and deviations s of two vectors in a segment of length L, their
distance there is at least L ((m - m')^2 + (s - s')^2), and since |v|^2 = sum L (m^2 + s^2), the inner
product (|v|^2 + |w|^2 - d^2) / 2 is at most sum L (m m' + s s'). So a level's statistics, scaled by the root
of L, are short vectors whose product bounds the score from above; more segments bound it closer.

1. Rows are packed into blocks with an even number each, whatever their ids. Blocks of candidates and of
   queries fall into groups of bounded size, and each pair of groups is a task of bounded memory: a query
   block is sent to each group of candidates, a candidate block to each group of queries.
2. In a task candidates stand by falling length. For a tile of them the coarsest bounds of all queries are
   one product; the most promising few are scored exactly and raise what a query asks for; those that
   can't reach it go, the others meet finer levels, and the survivors are scored exactly, in integers.
3. The best rows of all tasks are ranked per query.

Cases: rows without an id, and vectors that are null or hold a null or a number that is not finite, take no
part. Of vectors of different lengths the shorter counts as filled up with zeros, an empty one as zeros.
Equal rows (id and vector) are one query but as many candidates as there are rows; rows with the id of a query
are not its candidates; rows with one id and different vectors are queries of their own. Scores
beyond 64 bits count as the largest or least of them. Without queries or candidates the result is empty.
Only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments of each level, coarse to fine.
LEVELS = (8, 32)
#: Rows and bytes of a block, candidates and queries of a group, candidates looked at together.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
GROUP_BYTES, LEAST_GROUPS = 32 << 20, 48
TILE = 4096
PAIRS = 1 << 16
#: Share of a tile's pairs from which on a level is a product of the whole tile.
DENSE = 0.1
#: What a bound is raised by, as a share of the product of both lengths, against rounding.
SLACK = 1e-6

BLOCK = "number long, n int, dims int, kind string, ids binary, keys binary, vectors binary"
LONG = np.iinfo(np.int64)
FINITE = np.finfo(np.float64).max


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))


def whole(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array) -> np.ndarray:
    """Rounded-down components, a row a vector, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False)), -FINITE, FINITE)
    dims = int(lengths.max(initial=0))
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() * 7
    for batch in batches:
        vectors = matrix(batch.column("vector"))
        top = np.abs(vectors).max(initial=0)
        kind = next((k for k in ("int16", "int32") if top <= np.iinfo(k).max), "float64")
        ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
        rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8 * vectors.shape[1], 1)))
        blocks = []
        for at in range(0, len(ids), rows):
            part = vectors[at : at + rows]
            blocks.append((number, len(part), vectors.shape[1], kind, ids[at : at + rows].tobytes(), keys[at : at + rows].tobytes(), part.astype(kind).tobytes()))
            number += 1
        if blocks:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            names = [field.split()[0] for field in BLOCK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), types, strict=True)], names)


class Rows:
    """Ids, keys and vectors of many blocks, with their lengths and the statistics of each level."""

    def __init__(self, blocks: pa.Table, dims: int, levels: tuple[int, ...], longest_first: bool):
        read = blocks.to_pylist()
        self.ids = np.concatenate([np.frombuffer(b["ids"], np.int64) for b in read])
        self.keys = np.concatenate([np.frombuffer(b["keys"], np.int64) for b in read])
        self.vectors = np.zeros((len(self.ids), dims))
        at = 0
        for b in read:
            self.vectors[at : at + b["n"], : b["dims"]] = np.frombuffer(b["vectors"], b["kind"]).reshape(b["n"], b["dims"])
            at += b["n"]
        self.length = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        if longest_first:
            order = np.argsort(-self.length, kind="stable")
            self.ids, self.keys, self.vectors, self.length = self.ids[order], self.keys[order], self.vectors[order], self.length[order]
        self.levels = [statistics(self.vectors, level) for level in levels]
        self.top = float(np.abs(self.vectors).max(initial=0))


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their lengths."""
    dims = vectors.shape[1]
    bounds = np.unique(np.linspace(0, dims, min(segments, dims) + 1).astype(np.int64))
    if dims == 0:
        return np.zeros((len(vectors), 0))
    size = np.diff(bounds)
    mean = np.add.reduceat(vectors, bounds[:-1], axis=1) / size
    rest = vectors - np.repeat(mean, size, axis=1)
    return np.hstack((mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, bounds[:-1], axis=1))))


def exact(queries: np.ndarray, candidates: np.ndarray, small: bool) -> np.ndarray:
    """Inner products row by row; `small` tells that doubles hold every partial sum."""
    if small:
        return np.einsum("ij,ij->i", queries, candidates).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(q.tolist(), c.tolist(), strict=True)) for q, c in zip(queries, candidates, strict=True))
    return np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.asked = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        query, score, id_ = np.concatenate((self.query, query)), np.concatenate((self.score, score)), np.concatenate((self.id, id_))
        # ~score turns the order of 64-bit numbers without overflow.
        order = np.lexsort((id_, ~score, query))
        query, score, id_ = query[order], score[order], id_[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        self.query, self.score, self.id = query[kept], score[kept], id_[kept]
        full = np.arange(len(query))[kept] - first[kept] == self.k - 1
        self.asked[self.query[full]] = np.where(self.score[full] == LONG.min, -np.inf, self.score[full])


def search(queries: Rows, candidates: Rows, some: slice, k: int, seen: list | None = None) -> Best:
    """The k best candidates of some queries, coarse to fine; `seen` gathers the pairs left after each step."""
    ids, length, asking = queries.ids[some], queries.length[some], queries.vectors[some]
    levels = [(q[some], c) for q, c in zip(queries.levels, candidates.levels, strict=True)]
    best = Best(len(ids), k)
    small = queries.top * candidates.top * max(asking.shape[1], 1) < 2**53
    for at in range(0, len(candidates.ids), TILE):
        tile = slice(at, at + TILE)
        slack = SLACK * length[:, None] * candidates.length[tile] + SLACK
        bound = np.where(ids[:, None] == candidates.ids[tile], -np.inf, np.inf)
        left, step = [], 0
        while True:
            reach = (bound > -np.inf) & (bound >= best.asked[:, None])
            left.append(int(reach.sum()))
            if step == len(levels) or left[-1] < DENSE * bound.size:
                break
            # While many pairs are left, one product of the tile costs less than a bound a pair.
            finer = levels[step][0] @ levels[step][1][tile].T + slack
            bound = np.where(reach, np.where(np.isfinite(finer), np.minimum(finer, bound), bound), -np.inf)
            step += 1
            # The most promising candidates are scored at once, so that less is left to the next level.
            first = np.argpartition(-bound, k, axis=1)[:, :k] if bound.shape[1] > k else np.tile(np.arange(bound.shape[1]), (len(ids), 1))
            q, c = np.repeat(np.arange(len(ids)), first.shape[1]), first.ravel()
            promising = (bound[q, c] > -np.inf) & (bound[q, c] >= best.asked[q])
            q, c = q[promising], c[promising]
            best.add(q, exact(asking[q], candidates.vectors[at + c], small), candidates.ids[at + c])
            bound[q, c] = -np.inf
        q, c = np.nonzero(reach)
        # Pairs go through the other levels a bounded number at a time; what is found asks more of the next.
        for cut in range(0, len(q), PAIRS):
            qs, cs = q[cut : cut + PAIRS], c[cut : cut + PAIRS]
            for fine, other in levels[step:]:
                reach = ~(np.einsum("ij,ij->i", fine[qs], other[at + cs]) + slack[qs, cs] < best.asked[qs])
                qs, cs = qs[reach], cs[reach]
            left.append(len(qs))
            best.add(qs, exact(asking[qs], candidates.vectors[at + cs], small), candidates.ids[at + cs])
        if seen is not None:
            seen.append(left)
    return best


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product with each query row.

    Components count as floor(scale * x). `queries` is a condition on the columns of `vectors`.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & whole(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), scaled(F.col(vector_col), scale).alias("vector")
    )
    # Sorted, so that a task that runs again packs the same blocks.
    asking = rows.filter("asks").drop("asks").dropDuplicates(["id", "vector"]).withColumn("key", F.xxhash64("vector")).sortWithinPartitions("id", "key")
    held = rows.drop("asks").withColumn("key", F.lit(0).cast("long"))
    # Eight bytes a component in a task; the components of all rows tell how many groups they need.
    bytes_of = F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))
    sizes = rows.agg(bytes_of.alias("all"), F.coalesce(F.sum(F.when(F.col("asks"), F.size("vector") * 8 + 16)), F.lit(0)).alias("asking")).first()
    candidate_groups = max(LEAST_GROUPS, -(-sizes["all"] // GROUP_BYTES))
    query_groups = max(1, -(-sizes["asking"] // GROUP_BYTES))

    def blocks(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        packed = rows.select("id", "key", "vector").mapInArrow(_pack, BLOCK)
        mine = packed.withColumn(own, F.pmod("number", F.lit(n_own)).cast("int"))
        return mine.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] * 4]
        if len(left) and len(right):
            dims = max(b for t in (left, right) for b in t.column("dims").to_pylist())
            asked, candidates = Rows(left, dims, levels, longest_first=False), Rows(right, dims, levels, longest_first=True)
            for at in range(0, len(asked.ids), BLOCK_ROWS):
                best = search(asked, candidates, slice(at, at + BLOCK_ROWS), k)
                found.append([asked.ids[at:][best.query], asked.keys[at:][best.query], best.id, best.score])
        return pa.table(dict(zip(("query_id", "key", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    left = blocks(asking, "query_group", query_groups, "candidate_group", candidate_groups)
    right = blocks(held, "candidate_group", candidate_groups, "query_group", query_groups)
    cells = ("candidate_group", "query_group")
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(meet, "query_id long, key long, vec_id long, score long")
    ranked = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
