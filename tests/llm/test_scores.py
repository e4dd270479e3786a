"""Top-k search, resampling and token alignment against brute force, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linemend.llm import align, crc, queries, resample, segments, toxicity

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "Ü é 日本 😀 x"),
    (6, "a b c d e f g h i j k l m n o p q r s t"),
    (6, "a b c d e f g h i j k l m n o p q r s t"),
    (7, "A b  c D e f-g h,i j k l m\nn o p q r s t u"),
    (8, "<|endoftext|> and <s> ▁ a"),
    (9, "<|endoftext|> and <s> <0x41> <unk>"),
    (None, "the same line of text"),
    (10, "word " * 30000),
    (11, "x" * 50000),
    (12, " " * 20000 + "y"),
    (13, "line\r\n\n\ttab nbsp　wide ​\x00\x01 end "),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    rows = [(i, t, "x", i, None, 7, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, id long, score string, rank int, links string")


def docs_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


# CRC of spans ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 100_000])
def test_crc_of_spans(n):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 256, n, dtype=np.uint8)
    prefixes = crc.Prefixes(data)
    ends = rng.integers(0, n + 1, 200)
    starts = np.array([int(rng.integers(0, e + 1)) for e in ends])
    expected = [zlib.crc32(data[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
    assert prefixes.spans(starts, ends).tolist() == expected


# Resampling --------------------------------------------------------------------------


def brute_resample(docs, target, shortest=1, longest=1, buckets=10_000, percent=10, least=20, seed="2024"):
    def features(t):
        w = WORD.findall((t or "").translate(LOW))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    rows = []
    for i, w, f in held:
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in f
        )
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(enough) // 100
    return [(*r, n if n <= drawn else None) for n, r in enumerate(enough, 1)] + [(*r, None) for r in rows if r[1] < least]


@pytest.mark.parametrize("features,percent,least", [(resample.Features(), 10, 20), (resample.Features(1, 3, 500), 60, 1), (resample.Features(2, 2, 97), 100, 5)])
def test_resample_equals_brute_force(spark, odd, features, percent, least):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = docs_of(spark) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resample.resample(docs, bench, features=features, percent=percent, least_words=least)
    expected = brute_resample(rows, [r.text for r in bench.collect()], features.shortest, features.longest, features.buckets, percent, least)
    assert got.columns == ["id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_resample_odd(spark, odd):
    out = resample.resample(odd, odd.limit(0))
    assert Counter(map(tuple, out.collect())) == Counter(brute_resample(ODD, []))
    assert resample.resample(odd.limit(0), odd).count() == 0


def test_ranks_of_many_equal_rows(spark):
    """One row, repeated, is more than half of all rows: the ranks stay without gaps."""
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("a " * 25).alias("text"))
    ranks = [r.rank for r in resample.resample(rows, rows, percent=50).collect() if r.rank is not None]
    assert sorted(ranks) == list(range(1, 1501))


# Top-k -------------------------------------------------------------------------------


def brute_top(rows, asks, k, scale):
    def vector(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    held = [(i, u) for i, v in rows if i is not None and (u := vector(v)) is not None]
    out = []
    for i, v in {(i, tuple(v)) for i, v in held if asks(i)}:
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for j, w in held if j != i)
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return out


def test_top_k_equals_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding").collect()]
    for levels in ((8, 32), (1,), (2, 4, 64), (500,)):
        got = segments.top_k(table, F.col("vec_id") % 20 == 0, k=7, scale=100, levels=levels)
        assert Counter(map(tuple, got.collect())) == Counter(brute_top(rows, lambda i: i % 20 == 0, 7, 100)), levels


def test_top_k_in_clusters(spark):
    """Close groups, where bounds do prune, and small whole numbers with many ties."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24)) * 3
    close = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=24) * 0.01).tolist()) for i in range(600)]
    ties = [(i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(600)]
    for rows in (close, ties):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
        got = segments.top_k(df, F.col("vec_id") % 50 == 0)
        assert Counter(map(tuple, got.collect())) == Counter(brute_top(rows, lambda i: i % 50 == 0, 5, 256))


def test_bounds_prune(spark):
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.normal(size=(40, 8)), 8, axis=1).repeat(100, axis=0) * 50 + rng.normal(size=(4000, 64))

    def rows(v, first):
        block = {"ids": np.arange(len(v)).tobytes(), "keys": np.arange(len(v)).tobytes(), "n": len(v), "dims": 64, "kind": "float64", "vectors": np.floor(v).tobytes()}
        return segments.Rows(segments.pa.Table.from_pylist([block]), 64, (8, 32), first)

    seen = []
    segments.search(rows(vectors[:200], False), rows(vectors, True), slice(0, 200), 5, seen)
    pairs, after = seen[0][0], seen[0][1]
    assert after < pairs / 4


def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]),
        (5, [inf, 1.0]), (6, []), (7, [-1.0, 0.001, 4.0]), (50, [1e30, -1e30]), (51, [1e30, 1e30]), (100, [0.0, 0.0]), (None, [9.0, 9.0]), (150, None),
        (52, [3.0e38, 3.0e38]), (200, [-3.0e38, 3.0e38]),
    ]
    df = spark.createDataFrame([(i, v, i, "k", v) for i, v in rows], "vec_id long, embedding array<float>, id long, key string, vector array<float>")
    limits = np.iinfo(np.int64)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    held = [(i, v) for i, v in as_float]
    expected = []
    for q, n, c, s in brute_top(held, lambda i: i % 50 == 0, 1000, 256):
        expected.append((q, c, min(max(s, limits.min), limits.max)))
    got = segments.top_k(df, F.col("vec_id") % 50 == 0, k=1000).collect()
    assert Counter((r.query_id, r.vec_id, r.score) for r in got) == Counter(expected)
    by_query = defaultdict(list)
    for r in got:
        by_query[r.query_id].append(r["rank"])
    assert sorted(by_query[50]) == list(range(1, len(by_query[50]) + 1))
    top = segments.top_k(df, F.col("vec_id") % 50 == 0, k=2).collect()
    best = defaultdict(list)
    for q, c, s in sorted(expected, key=lambda x: (x[0], -x[2], x[1])):
        best[q].append((c, s))
    for q in (50, 100, 200):
        assert [(r.vec_id, r.score) for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == q] == best[q][:2]
    assert segments.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert segments.top_k(df, F.col("vec_id") == 150).count() == 0
    assert segments.top_k(df, F.lit(None).cast("boolean")).count() == 0


# Alignment ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def byte_of_letter():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def brute_align(rows, path_a, path_b):
    a, b, letters = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), byte_of_letter()
    a.encode_special_tokens = True
    out, counts = [], Counter()
    for i, t in rows:
        ta = tb = []
        if t:
            ta = [(n, bytes(letters[c] for c in a.id_to_token(n))) for n in a.encode(f" {t}", add_special_tokens=False).ids]
            tb = [(n, bytes([int(b.id_to_piece(n)[3:5], 16)]) if b.is_byte(n) else b.id_to_piece(n).replace("▁", " ").encode()) for n in b.encode(t)]
            if b"".join(x for _, x in ta) != f" {t}".encode() or b"".join(x for _, x in tb) != f" {t}".encode():
                ta = tb = []
        ends = [], []
        for side, tokens in zip(ends, (ta, tb), strict=True):
            at = 0
            for n, x in tokens:
                at += len(x)
                side.append((at, n))
        b_at, links, groups, ga, gb, k = dict(ends[1]), [], [], [], [], 0
        for at, n in ends[0]:
            ga.append(n)
            if at in b_at:
                while k < len(ends[1]) and ends[1][k][0] <= at:
                    gb.append(ends[1][k][1])
                    k += 1
                links.append((n, b_at[at]))
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        counts.update(links)
        out.append((i, len(ta), len(tb), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, n), c in counts.items():
        best[n] = max(best[n], c)
    return [
        (i, na, nb, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for i, na, nb, links, g in out
    ]


def test_alignment_equals_brute_force(spark, odd, paths):
    rows = docs_of(spark) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    got = align.compare(docs, *paths, spans=True)
    assert Counter(map(tuple, got.select(names).collect())) == Counter(brute_align(rows, *paths))
    for row in got.collect():
        assert len(row.group_ends) == row.n_groups and row.group_ends == sorted(row.group_ends)


def test_alignment_odd(spark, odd, paths):
    got = {(r.id, r.n_a, r.n_groups) for r in align.compare(odd, *paths).collect()}
    for doc in (1, 2, 8):
        assert (doc, 0, 0) in got
    assert len([g for g in got if g[1] == 0]) < len(ODD) / 2
    assert align.compare(odd.limit(0), *paths).count() == 0


def test_fast_cut_equals_library(paths):
    """The compiled merge gives the library's ids on every assigned character of the first planes."""
    side = align.ByteLevel(paths[0])
    assert side.fast is not None
    texts = [" " + "".join(f"a{chr(c)}b{chr(c)}1 {chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(1, 0x30000, 64)]
    slow = [e.ids for e in side.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [side.encode(t).tolist() for t in texts] == slow


@pytest.mark.parametrize("wrong", [0.02, 0.1])
def test_label_model_estimates_accuracies_and_correlations(wrong):
    """Planted: six voters, three copies of the first among them, and given labels of which some are wrong."""
    rng = np.random.default_rng(5)
    toxic = rng.random(8000) < 0.3
    own = rng.random((8000, 6)) < np.where(toxic[:, None], 0.6, 0.02)
    votes = np.concatenate([own, np.repeat(own[:, :1], 3, axis=1)], axis=1)
    given = np.where(rng.random(8000) < wrong, ~toxic, toxic).astype(int)
    model = toxicity.label_model(votes, given, votes.shape[1])
    # Wrong labels make the share of toxic texts that is held seem larger than it is, at the cost of the first accuracy.
    assert abs(model.given_right[1] - (1 - wrong)) < 0.02 and -0.02 < 1 - wrong - model.given_right[0] < wrong
    assert ((model.posterior >= 0.5) == toxic).mean() > 1 - wrong / 2
    # The four equal voters hang together and count once: with its parent firing a copy adds nothing.
    family = [0, 6, 7, 8]
    tied = [v for v in family if model.parent[v] >= 0]
    assert len(tied) == 3 and all(model.parent[v] in family for v in tied) and (model.parent[1:6] == -1).all()
    assert all(model.fired[1, v] < 0.05 for v in tied) and (model.fired[0, 1:6] > 2).all()


def test_label_model_without_given_votes_and_without_any_vote():
    rng = np.random.default_rng(6)
    toxic = rng.random(4000) < 0.3
    votes = rng.random((4000, 8)) < np.where(toxic[:, None], 0.6, 0.02)
    model = toxicity.label_model(votes, toxic.astype(int), 8, given_votes=False)
    assert model.given_right is None and ((model.posterior >= 0.5) == toxic).mean() > 0.97
    silent = toxicity.label_model(np.zeros((50, 3), bool), np.arange(50) % 2, 3)
    assert np.isfinite(silent.posterior).all() and (silent.parent == -1).all()
    none = toxicity.label_model(np.zeros((50, 0), bool), np.arange(50) % 2, 0)
    assert np.isfinite(none.posterior).all()
