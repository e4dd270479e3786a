"""N-gram Jaccard join with signature trees.

A document's set holds its distinct shingles of some words. Two sets link when their Jaccard
similarity reaches a threshold. Both are parameters (`Rule`), and all bounds below follow from them;
the numbers in the text are those of 3 words and 0.9, the defaults.

1. Equal sets are one class, known by its fingerprint, however many documents share it.
2. Segments. With sets of sizes a and b, at most (a + b) / 19 shingles differ between linked ones.
   The hash range is cut into one segment more than that, so linked sets agree in a whole segment.
   Sizes fall into bands, and a set is cut by its own band and by those below it from which a
   smaller partner may come. A segment of fewer than two shingles tells nothing. A set with more
   telling segments than shingles can differ agrees in one of those; any other is cut again by
   another hash, up to `CUTS` times. Those left then tell their prefix: in one order of all
   shingles, linked sets of a and b share one among the first a - t a + 1 and b - t b + 1.
   Where segments would hold fewer than `LEAST_SEGMENT` shingles (thresholds below about 0.86), too
   few would tell; there more are cut, of `CUT_SIZE` shingles, about as many telling ones as can be.
   Chunks send their segment hashes to shards and learn which ones other classes hold.
3. Only classes that share a segment go on, with their sets. Classes around a segment form
   clusters. A cluster of up to `BLOCK` classes is one tree, larger ones are dealt into blocks by
   size, and pairs of blocks whose sizes allow a link are compared.
4. Signature trees. A node holds the OR of its members' token bitmaps and their range of sizes.
   Two trees are walked together: the most tokens that any two members can share is bounded by the
   bits that both nodes have and by the sizes, and pairs of nodes that can't reach the threshold
   are cut off. What is left at the leaves is compared exactly.
5. Links join classes to components.

Links are counted where they are found; only a spanning forest of each comparison is written, so a
group of a million near copies gives a million rows and not their square.

Nulls: null and empty texts have empty sets and link with nothing. A null id links as any other,
but gives a component no name. Rows with one id and different texts are documents of their own.
Words are hashed to 64 bits, shingles likewise.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir
from . import graph, shards, text
from .batches import free_name

CUTS = 6
LEAST_SEGMENT = 6
CUT_SIZE = 2.5
BLOCK = 1024
#: Classes that one task takes of small clusters.
GROUP = 2048
#: Large clusters, rows of 16 bytes, that may be broadcast.
BROADCAST_ROWS = 1 << 18
BITMAP = 4096
FAN_OUT = 8

RECORDS = "id long, text_hash long, n_shingles long, class long, keys array<long>, tokens binary"
PROBES = "shard int, chunk long, n long, keys binary, low binary, high binary"
FOUND = "a long, b long, links long"


def _bands(most: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands, each about a quarter longer than the one before."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


BANDS = _bands()
_LARGEST = BANDS[1:] - 1


class Rule(NamedTuple):
    """Words of a shingle, and the similarity in hundredths from which sets link."""

    shingle: int = 3
    percent: int = 90

    @property
    def reach(self) -> np.ndarray:
        """The largest partner of a set of each band."""
        return _LARGEST * 100 // self.percent

    @property
    def segments(self) -> np.ndarray:
        """Segments for the sets of each band."""
        least = self.differ(_LARGEST, self.reach) + 1
        return np.where(least * LEAST_SEGMENT < _LARGEST, least, np.maximum(least, (_LARGEST * 0.9 / CUT_SIZE).astype(np.int64)))

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles that differ between linked sets of a and b, at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def sizes_allow(self, high_a, low_a, high_b, low_b):
        """Whether sets of these ranges of sizes may link; for arrays and for columns."""
        return (100 * high_a >= self.percent * low_b) & (100 * high_b >= self.percent * low_a)


def rule_of(shingle: int, threshold: float) -> Rule:
    rule = Rule(shingle, round(100 * threshold))
    if shingle < 1 or not 1 <= rule.percent <= 100 or abs(rule.percent - 100 * threshold) > 1e-9:
        raise ValueError("shingles have a word at least, and the threshold is in whole hundredths from 0.01 to 1")
    return rule


class _Chunk:
    """Sets of the texts of a chunk: distinct shingles by text, sizes, classes and segment keys."""

    def __init__(self, table: pa.Table, plan: shards.Layout, rule: Rule):
        self.ids = text.longs(table["id"])
        data, offsets = text.text_bytes(table["text"])
        starts, ends, bounds = text.words(data, offsets)
        h = text.hashes(text.LOWER[data], starts, ends)
        at = text.gram_starts(bounds, rule.shingle)
        doc = text.owners(bounds)[at]
        gram = text.grams(h, at, rule.shingle)
        few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < rule.shingle))
        for n in range(1, rule.shingle):
            only = few[np.diff(bounds)[few] == n]
            doc = np.concatenate((doc, only))
            gram = np.concatenate((gram, text.grams(h, bounds[only], n)))
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]))) if len(doc) else np.zeros(0, bool)
        self.doc, self.gram = doc[fresh], gram[fresh]
        self.size = np.bincount(self.doc, minlength=len(self.ids))
        self.bounds = np.concatenate(([0], np.cumsum(self.size)))
        total = np.zeros(len(self.ids), np.uint64)
        np.add.at(total, self.doc, text.mix(self.gram ^ np.uint64(0x5851F42D4C957F2D)))
        self.cls = text.mix(total + self.size.astype(np.uint64))
        self.key_doc, key = self._keys(rule)
        self.key64 = key
        self.key = key >> np.uint64(32 - plan.shard_bits)
        self.order = np.argsort(self.key, kind="stable")
        ordered = self.key[self.order]
        self.first = text.runs(ordered)
        self.keys = ordered[self.first]
        self.of = np.empty(len(ordered), np.int64)
        self.of[self.order] = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(ordered))))

    def _prefixes(self, rule: Rule, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of the first shingles of some sets, in an order by hash."""
        mine = np.flatnonzero(np.isin(self.doc, who))
        order = mine[np.lexsort((text.mix(self.gram[mine] ^ np.uint64(0xE7037ED1A0B428DB)), self.doc[mine]))]
        size = self.size[who]
        n = size - -(-rule.percent * size // 100) + 1
        first = order[np.arange(int(n.sum())) + np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n)]
        return self.doc[first], text.mix(self.gram[first] ^ np.uint64(0xA0761D6478BD642F))

    def _keys(self, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of every segment that is told, and of prefixes."""
        most, segments = rule.reach, rule.segments
        docs, keys = [], []
        filled = np.flatnonzero(self.size > 0)
        own = np.searchsorted(BANDS, self.size[filled], "right") - 1
        todo, band = [filled], [own]
        below = own - 1
        while True:
            reach = (below >= 0) & (self.size[filled] <= most[np.maximum(below, 0)])
            if not reach.any():
                break
            todo.append(filled[reach])
            band.append(below[reach])
            below = below - 1
        who, band = np.concatenate(todo), np.concatenate(band)
        # The partner is at least as large in the set's own band, and no larger than the band in those below.
        partner = np.where(self.size[who] <= _LARGEST[band], self.size[who] * 100 // rule.percent, _LARGEST[band])
        for cut in range(CUTS):
            if not len(who):
                break
            n = segments[band]
            at = np.cumsum(n) - n
            size = self.size[who]
            token = np.arange(int(size.sum())) + np.repeat(self.bounds[who] - (np.cumsum(size) - size), size)
            salted = text.mix(self.gram[token] ^ np.uint64((cut + 1) * 0xA0761D6478BD642F % 2**64))
            slot = np.repeat(at, size) + (salted % np.repeat(n, size).astype(np.uint64)).astype(np.int64)
            count = np.bincount(slot, minlength=int(n.sum()))
            total = np.zeros(len(count), np.uint64)
            np.add.at(total, slot, text.mix(salted))
            owner = np.repeat(np.arange(len(who)), n)
            weak = (count < 2) & (n[owner] > 1)
            tell = ~weak
            place = (band[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(count)) - at[owner]).astype(np.uint64)
            key = text.mix(total + text.mix(place * np.uint64(CUTS) + np.uint64(cut)) + count.astype(np.uint64))
            docs.append(who[owner[tell]])
            keys.append(key[tell])
            again = np.bincount(owner[tell], minlength=len(who)) <= rule.differ(size, partner)
            who, band, partner = who[again], band[again], partner[again]
        doc, key = self._prefixes(rule, np.unique(who))
        docs.append(doc)
        keys.append(key)
        return np.concatenate(docs), np.concatenate(keys)


def _probe(plan: shards.Layout, rule: Rule, table: pa.Table) -> pa.Table:
    """A row per shard: distinct segment keys, with the least and the greatest class hash around each."""
    c = _Chunk(table, plan, rule)
    cls = (c.cls >> np.uint64(32)).astype("<u4")[c.key_doc][c.order]
    low = np.minimum.reduceat(cls, c.first) if len(c.first) else cls
    high = np.maximum.reduceat(cls, c.first) if len(c.first) else cls
    chunk = table["chunk"][0].as_py()
    rows = [
        (shard, chunk, part.stop - part.start, (c.keys[part] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), low[part].tobytes(), (high[part] ^ low[part]).tobytes())
        for shard, part in shards.cut(plan, c.keys, 32 + plan.shard_bits)
    ]
    names = ("shard", "chunk", "n", "keys", "low", "high")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})


def _shared(table: pa.Table) -> pa.Table:
    """Bits for the keys around which more than one class stands."""
    n = text.longs(table["n"]).tolist()
    keys, low, change = (np.frombuffer(b"".join(text.binaries(table[name])), "<u4") for name in ("keys", "low", "high"))
    order = np.argsort(keys, kind="stable")
    first = text.runs(keys[order])
    several = np.minimum.reduceat(low[order], first) != np.maximum.reduceat((low ^ change)[order], first)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(several, np.diff(np.append(first, len(keys))))
    return shards.answer(list(zip(text.longs(table["chunk"]).tolist(), n, strict=True)), 0, out, table["shard"][0].as_py())


def _records(plan: shards.Layout, rule: Rule, left: pa.Table, right: pa.Table) -> pa.Table:
    """A row per document; those that share a segment bring the shared keys and their set."""
    c = _Chunk(left, plan, rule)
    shared = shards.flags(plan, c.keys, 32 + plan.shard_bits, right.to_pylist(), 0)[c.of]
    doc, key = c.key_doc[shared], c.key64[shared]
    order = np.argsort(doc, kind="stable")
    key, at = key[order].view(np.int64), np.searchsorted(doc[order], np.arange(len(c.ids) + 1))
    gram = c.gram.astype("<u8")
    has = at[1:] > at[:-1]
    return pa.table(
        {
            "id": pa.array(c.ids, pa.int64(), mask=c.ids == 2**63 - 1),
            "text_hash": text.array_of(left["carry"]),
            "n_shingles": pa.array(c.size, pa.int64()),
            "class": pa.array(c.cls.view(np.int64), pa.int64()),
            "keys": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key, pa.int64())),
            "tokens": pa.array([gram[a:b].tobytes() if k else None for a, b, k in zip(c.bounds[:-1], c.bounds[1:], has, strict=True)], pa.binary()),
        }
    )


class Tree:
    """Signature tree over sets: level 0 are the sets, each level above joins `FAN_OUT` nodes."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        # Sets of like size and content stand together: by size band, then by their least token.
        least = np.array([int(s.min()) if len(s) else 0 for s in sets], np.uint64)
        self.members = np.lexsort((sizes, least, np.searchsorted(BANDS, sizes, "right")))
        sizes = sizes[self.members]
        maps = np.zeros((len(sets), BITMAP // 64), np.uint64)
        for row, i in enumerate(self.members):
            bit = sets[i] & np.uint64(BITMAP - 1)
            np.bitwise_or.at(maps[row], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        # Tokens that share a bit with another one of the set: so many more may be common than bits are.
        extra = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, extra)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, extra = self.levels[-1]
            at = np.arange(0, len(maps), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))


def _possible(rule: Rule, one: Tree, two: Tree, level_one: int, level_two: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold a link."""
    maps_a, low_a, high_a, extra_a = one.levels[level_one]
    maps_b, low_b, high_b, extra_b = two.levels[level_two]
    out = np.flatnonzero(rule.sizes_allow(high_a[a], low_a[a], high_b[b], low_b[b]))
    keep = np.zeros(len(a), bool)
    for at in range(0, len(out), 8192):
        part = out[at : at + 8192]
        x, y = a[part], b[part]
        bits = np.bitwise_count(maps_a[x] & maps_b[y]).sum(axis=1).astype(np.int64)
        most = np.minimum(bits + np.minimum(extra_a[x], extra_b[y]), np.minimum(high_a[x], high_b[y]))
        keep[part] = (100 + rule.percent) * most >= rule.percent * (low_a[x] + low_b[y])
    return keep


def candidates(rule: Rule, one: Tree, two: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that the walk of two trees, or of one with itself, can't rule out."""
    self_join = two is None
    two = one if two is None else two
    la, lb = len(one.levels) - 1, len(two.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = _possible(rule, one, two, la, lb, a, b)
        a, b = a[keep], b[keep]
        if la == 0 and lb == 0:
            break
        # The higher tree goes down, both do where they are level.
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        if down_a:
            a, b = _children(a, b, len(one.levels[la - 1][0]))
            la -= 1
        if down_b:
            b, a = _children(b, a, len(two.levels[lb - 1][0]))
            lb -= 1
        if self_join and la == lb:
            half = a <= b
            a, b = a[half], b[half]
    if self_join:
        a, b = a[a < b], b[a < b]
    return one.members[a], two.members[b]


def _children(parent: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (parent[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
    real = child < n
    return child[real], np.repeat(other, FAN_OUT)[real]


def linked(rule: Rule, one: list[np.ndarray], two: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index, index) of linked sets: candidates of the trees, compared exactly."""
    if not one or (two is not None and not two):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = candidates(rule, Tree(one), Tree(two) if two is not None else None)
    right = one if two is None else two
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    # Tokens as numbers without gaps, so that the set of one side is a row of flags.
    used, inverse = np.unique(np.concatenate([*one, *(two or [])]), return_inverse=True)
    cuts = np.cumsum([len(s) for s in one] + [len(s) for s in two or []])[:-1]
    codes = np.split(inverse, cuts)
    code_b = codes if two is None else codes[len(one) :]
    flags = np.zeros(len(used), np.int64)
    keep = np.zeros(len(a), bool)
    first = text.runs(a).tolist()
    for at, to in zip(first, [*first[1:], len(a)] if first else [], strict=True):
        mine = codes[a[at]]
        flags[mine] = 1
        for part in range(at, to, 256):
            others = b[part : min(part + 256, to)]
            size = np.array([len(right[i]) for i in others])
            sums = np.concatenate(([0], np.cumsum(flags[np.concatenate([code_b[i] for i in others])])))
            ends = np.cumsum(size)
            common = sums[ends] - sums[ends - size]
            keep[part : part + len(others)] = 100 * common >= rule.percent * (len(mine) + size - common)
        flags[mine] = 0
    return a[keep], b[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that are enough to join what all pairs join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _compare(rule: Rule, table: pa.Table) -> pa.Table:
    """Links among the sets of a group: clusters and pairs of blocks one by one."""
    pairs = np.array(text.array_of(table["pair"]).to_pylist(), object)
    side = text.longs(table["side"])
    cls, copies = text.longs(table["class"]), text.longs(table["copies"])
    tokens = [np.frombuffer(t, "<u8") for t in text.binaries(table["tokens"])]
    names, of = np.unique(pairs.astype(str), return_inverse=True)
    order = np.argsort(of, kind="stable")
    rows: list[tuple] = []
    for members in np.split(order, np.cumsum(np.bincount(of, minlength=len(names)))[:-1]):
        left, right = members[side[members] == 0], members[side[members] == 1]
        if len(right):
            i, j = linked(rule, [tokens[m] for m in left], [tokens[m] for m in right])
            i, j = left[i], right[j]
        else:
            i, j = linked(rule, [tokens[m] for m in left])
            i, j = left[i], left[j]
        links = np.zeros(len(cls), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        rows += [(int(cls[m]), None, int(links[m])) for m in members[links[members] > 0]]
        rows += [(int(cls[x]), int(cls[y]), 0) for x, y in _forest(i, j)]
    return pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("a", "b", "links"))})


def _blocks(classes: DataFrame, rule: Rule) -> DataFrame:
    """(grp, pair, side, class, copies, tokens): what is compared with what, dealt into groups of like size."""
    counts = classes.groupBy("cluster").agg(F.count("*").alias("n_cluster")).filter(F.col("n_cluster") > BLOCK)
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(np.log(1.25)))).cast("int")
    rows = classes.join(counts, "cluster", "left").withColumn("band", band)
    small = rows.filter("n_cluster is null")
    groups = max(1, -(-small.count() // GROUP))
    whole = small.select(
        F.pmod(F.xxhash64("cluster"), F.lit(groups)).cast("string").alias("grp"),
        F.col("cluster").cast("string").alias("pair"),
        F.lit(0).alias("side"),
        "class",
        "copies",
        "tokens",
    )
    large = rows.filter("n_cluster is not null")
    in_band = large.groupBy("cluster", "band").agg(F.count("*").alias("n_band"))
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("n_band") / F.lit(float(BLOCK))))
    dealt = large.join(in_band, ["cluster", "band"]).withColumn("block", F.concat_ws(".", "cluster", "band", part))
    nodes = dealt.groupBy("cluster", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    other = nodes.select("cluster", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # Blocks, not documents: pairs of nodes whose sizes allow a link.
    near = (F.col("block") <= F.col("block2")) & rule.sizes_allow(*map(F.col, ("high", "low", "high2", "low2")))
    pairs = nodes.join(other, "cluster").filter(near).withColumn("pair", F.concat_ws("|", "block", "block2"))
    sides = pairs.select("pair", "block", F.lit(0).alias("side")).unionByName(
        pairs.filter("block <> block2").select("pair", F.col("block2").alias("block"), F.lit(1).alias("side"))
    )
    crossed = dealt.join(sides, "block").select(F.col("pair").alias("grp"), "pair", "side", "class", "copies", "tokens")
    return whole.unionByName(crossed)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: float = 0.9) -> DataFrame:
    """(id, text_hash, n_shingles, class, copies, n_links, component_id, root), one row for each row of the input.

    `text_hash` is xxhash64 of the text, `class` names equal sets, `root` the class that names a component, `copies` counts their documents, `n_links` all documents that this
    one links with, copies included; `component_id` is the least id reachable by links. `threshold` is in whole hundredths.
    """
    spark, rule = docs.sparkSession, rule_of(shingle, threshold)
    plan = shards.layout(docs, text_col)

    def probe(table: pa.Table) -> pa.Table:
        return _probe(plan, rule, table)

    def record(left: pa.Table, right: pa.Table) -> pa.Table:
        return _records(plan, rule, left, right)

    def compare(table: pa.Table) -> pa.Table:
        return _compare(rule, table)

    chunks = shards.chunked(docs, plan, id_col, text_col, F.xxhash64(F.col(text_col)))
    told = chunks.groupBy("chunk").applyInArrow(probe, PROBES).groupBy("shard").applyInArrow(_shared, shards.BITS)
    path = work_dir(spark, "sets")
    chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(record, RECORDS).write.parquet(path)
    records = spark.read.parquet(path)

    filled = records.filter("n_shingles > 0")
    classes = filled.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    sharing = filled.filter("tokens is not null")
    keys = sharing.select("class", F.explode("keys").alias("key")).distinct()
    heads = keys.groupBy("key").agg(F.min("class").alias("head"), F.max("class").alias("tail")).filter("head < tail")
    clusters = graph.components(keys.join(heads, "key").filter("class <> head").select("class", "head").distinct())
    sets = sharing.groupBy("class").agg(F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"))
    members = clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(sets, "class").join(classes.select("class", "copies"), "class")
    path = work_dir(spark, "members")
    members.write.parquet(path)

    path_found = work_dir(spark, "links")
    _blocks(spark.read.parquet(path), rule).groupBy("grp").applyInArrow(compare, FOUND).write.parquet(path_found)
    found = spark.read.parquet(path_found)
    joined = graph.components(found.filter("b is not null").select("a", "b"))
    degrees = found.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = joined.select(F.col("node").alias("class"), "root")
    named = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    about = named.join(names, "root").join(degrees, "class", "left").select("class", "copies", "component_id", "root", F.coalesce("links", F.lit(0)).alias("links"))
    return records.select("id", "text_hash", "n_shingles", "class").join(about, "class", "left").select(
        "id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("class")).alias("class"),
        F.when(F.col("n_shingles") > 0, F.col("copies")).otherwise(F.lit(1)).alias("copies"),
        F.when(F.col("n_shingles") > 0, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: float = 0.9) -> DataFrame:
    """The rows of `docs`, all columns, of the document with the least id of each component.

    Documents without words stay. Rows that repeat both id and text are one document and stay
    together; of several texts under the least id one stays.
    """
    last = F.lit(2**63 - 1)
    found = link(docs, id_col, text_col, shingle, threshold)
    id_, hash_ = (free_name(n, docs.columns) for n in ("_id", "_hash"))
    key = F.struct(F.coalesce("id", last).alias(id_), F.col("text_hash").alias(hash_))
    heads = found.filter("root is not null").groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    kept = heads.unionByName(found.filter("root is null").select(key.alias("k")).select("k.*"))
    same = (F.coalesce(F.col(id_col).cast("long"), last) == F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_))
    return docs.join(kept, same, "left_semi")
