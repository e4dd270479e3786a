"""The operators of `linemend.llm` against brute force, and on odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linemend.llm import decontaminate, graph, hashing, jaccard, language, lines, packing, quality, queries, quotes, shards, substrings, text, tokens, toxicity, urls

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "Ü é 日本 😀 x"),
    (6, "a b c d e f g h i j k l m n o p"),
    (6, "a b c d e f g h i j k l m n o p"),
    (7, "A b  c d e f g h i j k l m\nn o p"),
    (8, "the same line of text\nother\nThe same line of text "),
    (9, "the same line of text\n\n"),
    (None, "the same line of text"),
    (10, "w " * 30000),
    (11, "a b c d e f g h i j k l m n o p"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    rows = [(i, t, "x", i, None, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, id long, carry string, shard string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if sql))
def test_query_equals_sql(spark, name):
    function, sql = queries.QUERIES[name]
    df, connection = function(spark, FOLDER), compare.connect(FOLDER)
    assert compare.type_difference(df, connection, sql) is None
    assert compare.difference(df, connection, sql) is None


def _removed(rows):
    first, out = {}, []
    for doc, t in sorted(((2**63 if d is None else d), t) for d, t in rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), doc) < doc:
                gone[s : s + 13] = [True] * 13
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_substrings_on_odd_input(odd, empty):
    got = [(2**63 if r.id is None else r.id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(odd).collect()]
    assert sorted(got) == _removed([(d, t or "") for d, t in ODD])
    assert substrings.remove_repeats(empty).collect() == []


def _dropped(rows):
    keyed = [((2**63 if d is None else d), t or "") for d, t in rows]
    space = " \t\n\x0b\f\r"
    first = {}
    for doc, t in sorted(keyed):
        for line in t.split("\n"):
            key = line.strip(space).translate(LOW)
            if len(key) >= 10:
                first.setdefault(key, doc)
    out = []
    for doc, t in keyed:
        kept = [x for x in t.split("\n") if first.get(x.strip(space).translate(LOW), doc) >= doc]
        out.append((doc, len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_on_odd_input(odd, empty):
    got = [(2**63 if r.id is None else r.id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_lines(odd).collect()]
    assert sorted(got) == _dropped(ODD)
    assert lines.dedup_lines(odd).columns == odd.columns
    assert lines.dedup_lines(odd).filter("doc_id is null").first()["chunk"] == "x"
    assert lines.drop_lines(empty).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64))
    built = hashing.build(keys)
    assert sorted(hashing.places(keys, *built).tolist()) == list(range(len(keys)))
    assert hashing.places(keys, *hashing.build(keys[:0])).max() == -1


def test_quality_counts_equal_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, FOLDER).collect()}
    for row in docs.collect():
        w = WORD.findall(row.text or "")
        seen, dup = set(), 0
        for line in (row.text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        r = got[row.doc_id]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", row.text or ""))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), symbols, dup, len(inside), failed)
        assert not (failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()}
    judged = [r.kept for r in got.values() if r.doc_id in good and not r.base_failed]
    assert sum(judged) >= 0.95 * len(judged)


def test_quality_of_odd_input(odd, empty):
    named = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    keys = {c: F.col(c) for c in ("doc_id", "lang", "source")}
    rows = quality.judge(quality.measured(named, "text", keys)).collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows if r.n_words < 20)
    assert quality.judge(quality.measured(named.limit(0), "text", keys)).collect() == []


def test_quality_cutoffs_follow_the_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.measured(docs, "text", {c: F.col(c) for c in ("lang", "source")}).cache()
    found = [r.limits for r in quality.cutoffs(rows).collect()]
    for name, old in zip(quality.MEASURES, (0.25, 0.5, 0.2, 12.0, 2.5), strict=True):
        got = {r[name] for r in found}
        assert got != {old} or name == "dup_line_share"
        assert all(r > 0 for r in got)
    assert len({r["mean_word_long"] for r in found}) > 1


def test_quality_sketches_do_not_depend_on_the_dealing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.measured(docs, "text", {c: F.col(c) for c in ("lang", "source")}).cache()
    assert len({tuple(sorted(map(str, quality.cutoffs(rows.repartition(n)).collect()))) for n in (1, 7)}) == 1


@pytest.mark.parametrize("n", [1, 199, 200, 201])
def test_quality_cutoffs_move_evenly_with_the_size_of_a_group(spark, n):
    """No size at which other cutoffs take over: each document more draws a group towards its own sketch."""
    rows = [("en", "big", 0, 100, 5, 500, 0, 0)] * 1000 + [("en", "small", 0, 400, 5, 2000, 0, 0)] * n
    frame = spark.createDataFrame(rows, "lang string, source string, n_symbols long, n_words long, n_lines long, word_chars long, n_dup_lines long, n_repeat_words long")
    found = {r.source: r.limits.symbols_per_word for r in quality.cutoffs(frame).collect()}
    wider, own = found["big"], 3 / 400
    assert found["small"] == pytest.approx((n * own + quality.PRIOR * wider) / (n + quality.PRIOR), rel=0.01)


def test_quality_quantiles_against_sorting(spark):
    values = np.sort(np.random.default_rng(5).lognormal(4, 2, 3000).astype(int) + 1)
    rows = [("en", "s", 0, int(v), 1, 5 * int(v), 0, 0) for v in values]
    frame = spark.createDataFrame(rows, "lang string, source string, n_symbols long, n_words long, n_lines long, word_chars long, n_dup_lines long, n_repeat_words long")
    sketch = quality.sketches(frame, quality.work_dir(spark, "sketch-test"))
    found = quality.quantiles(sketch, "lang").filter("measure = 'n_words'").first()
    for q in (25, 50, 75):
        exact = values[-(-3000 * q // 100) - 1]
        assert exact * 127 / 128 <= found[f"q{q}"] <= exact


def test_quality_cutoffs_of_unlike_groups(spark):
    """Sources of long, short and junk documents: cutoffs follow the length, and junk gets none of its own."""
    plain, junk = "some words of plain text", "# $ % some words"
    rows = [(f"{i}{s}", "en", s, f"{plain} {i} " * n) for s, n in (("short", 5), ("long", 60)) for i in range(400)]
    rows += [(f"{i}junk", "en", "junk", f"{junk} {i} " * 9) for i in range(210)]
    frame = spark.createDataFrame(rows, "doc_id string, lang string, source string, text string")
    found = {r.source: r.limits for r in quality.cutoffs(quality.measured(frame, "text", {c: F.col(c) for c in ("lang", "source")})).collect()}
    assert 0 < found["long"].symbols_per_word < found["short"].symbols_per_word < 0.25
    assert found["junk"].symbols_per_word < 0.4


def test_url_parts_and_rules(spark):
    rows = [
        ("HTTP://A.Example.NET/en/x?q=/de/", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net", "example.net", "", None, None),
        ("http://x.net/de/", "x.net", "/de/", "net/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("http://example.com/de/1#/fr/", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://www.org/fr/", "www.org", "/fr/", "org/fr/", "allow"),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://?x", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, r[0], "a") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = sorted(urls.judge(pages, "url", {"page_id": F.col("page_id")}).collect())
    for r, (_, host, path, rule, verdict) in zip(got, rows, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), "url", {"page_id": F.col("page_id")}).collect() == []


def test_url_query_has_every_page(spark):
    rows = queries.op5_url_filters(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels if rows[r.doc_id].held_out]
    assert all(rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_toxicity_of_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model, "text", {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(odd, toxicity.fit(odd, labels.limit(0))).columns == odd.columns
    assert toxicity.keep_clean(empty, model).collect() == []


def _check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
    want = Counter()
    for doc, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want[(doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())] += 1
    got, bounds = Counter(), defaultdict(list)
    for r in rows:
        bounds[r.id].append(r)
    ids_of = defaultdict(list)
    for doc, t in texts:
        ids_of[doc].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
    for doc, found in bounds.items():
        crcs = Counter((r.start, r.length, r.ids_crc32) for r in found)
        exact = Counter()
        for ids in ids_of[doc]:
            for s in range(0, len(ids), packing.LENGTH):
                part = ids[s : s + packing.LENGTH]
                exact[(s, len(part), zlib.crc32(part.tobytes()))] += 1
        assert crcs == exact
        got[doc] = len(found)
    assert set(got) == set(ids_of)
    return sum(r.length for r in rows), len(by_sequence)


def test_packing_is_whole_and_tight(docs):
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    total, sequences = _check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sequences * packing.LENGTH <= 1.1 * total


def test_packing_of_odd_input(odd, empty):
    _check_packing(packing.pack(odd, queries.tokenizer_path()).collect(), ODD)
    assert packing.pack(empty, queries.tokenizer_path()).collect() == []


def test_tokens_of_odd_words():
    words = ["it's 'twas we'll I'M x's 12 3a4 <|endoftext|> a<|startoftext|>b é é ÀÉ ß µ ª ¿qué? don’t İ Σς ﬁ 日本語 😀 a\x1cb a\x85b !!!$$$", "''s 'S ...", ""]
    encoder = tokens.Encoder(queries.tokenizer_path())
    ids, places = encoder.batch(*text.text_bytes(pa.array(words)), 2)
    for i, t in enumerate(words):
        assert ids[places[i] : places[i + 1]].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_packing_bounds_open_windows():
    windows = packing.Windows(0)
    for n in np.random.default_rng(3).integers(1, packing.LENGTH + 1, 5000).tolist():
        windows.place(n)
        assert len(windows.sizes) <= packing.OPEN


def test_merge_passes_on_a_bounded_number_of_windows():
    used = np.random.default_rng(3).integers(2200, 4096, packing.OPEN * packing.FAN_IN)
    found = packing._merge(pd.DataFrame({"window": np.arange(len(used)), "used": used}))
    on, rest = (found[found.on == flag] for flag in (True, False))
    assert on.target.nunique() == packing.OPEN and on.target_used.max() <= rest.target_used.min()


@pytest.mark.parametrize(("hostile", "more"), [(False, 1.02), (True, 1.06)])
def test_merge_over_many_tasks(spark, hostile, more):
    """Three rounds' worth of tasks: each window lies whole in one sequence, gapless from 0.

    One merge of all needs few sequences less; with all large windows in one group, which can't all go on
    to meet the small ones of others, some more.
    """
    rng, tasks = np.random.default_rng(4), 64 * 64 + 5
    rows = [((task << packing.TASK_BITS) + 7, int(n)) for task, n in enumerate(rng.integers(1, 3000, tasks))]
    rows += [(((i % 64 if hostile else i) << packing.TASK_BITS) + 8 + i, 3000 + i // 64) for i in range(4096)]
    found = packing.merged(spark, spark.createDataFrame(rows, "window long, used long"), tasks).collect()
    used, by_target = dict(rows), defaultdict(list)
    for r in found:
        by_target[r.target].append((r.base, used[r.window]))
    assert sorted(r.window for r in found) == sorted(used)
    for parts in by_target.values():
        at = 0
        for base, n in sorted(parts):
            assert base == at
            at += n
        assert at <= packing.LENGTH
    at_once = packing._merge(pd.DataFrame(rows, columns=["window", "used"])).target.nunique()
    print("sequences", hostile, len(by_target), at_once)
    assert len(by_target) <= more * at_once


def test_leaks_equal_brute_force(spark, docs):
    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    items = {r.item_id: WORD.findall(r.text.translate(LOW)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(LOW))
        own = set(grams(w))
        for item, iw in items.items():
            g = grams(iw)
            if not own & set(g):
                continue
            for s in range(max(1, len(w) - len(iw) + 1)):
                c = grams(w[s : s + len(iw)])
                sim = sum((c & g).values()) / sum((c | g).values())
                if sim >= 0.8:
                    want[r.doc_id, item] = max(sim, want.get((r.doc_id, item), 0))
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op8_benchmark_decontamination(spark, FOLDER).collect()}
    assert want and got == pytest.approx(want)


def test_leaks_of_odd_input(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Ü é"), (4, "a b c d e f g h i j k l m n o p"), (4, "one")], "item_id long, text string")
    found = {(r.id, r.item) for r in decontaminate.leaks(odd, items).collect()}
    assert found == {(4, 4), (5, 3), (6, 4), (7, 4), (11, 4)}
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items).count() == len(ODD) - 6
    assert decontaminate.clean(odd, items.limit(0)).count() == len(ODD)
    assert decontaminate.leaks(empty, items).collect() == []


def test_language_on_held_out_documents(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op9_language_id(spark, FOLDER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows if r.held_out) >= 0.97 * sum(r.held_out for r in rows)


def test_language_of_odd_input(spark, odd, empty):
    train = spark.createDataFrame([("the and of", "en"), ("der die und", "de"), ("la", None), (None, "fr")], "text string, lang string")
    model = language.fit(train)
    assert model[0] == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predict(odd, model, "text", {"doc_id": F.col("doc_id")}).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred in model[0]
    assert {r.lang_pred for r in language.predict(odd, language.fit(train.limit(0)), "text").collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


def _links(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    degree = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                degree[i] += 1
                degree[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {i: min((rows[m][0] for m in members if rows[m][0] is not None), default=None) for members in groups.values() for i in members}
    return Counter((rows[i][0], len(sets[i]), least[i], degree[i]) for i in range(len(rows)))


def test_jaccard_equals_brute_force(spark, docs, odd, empty):
    for frame in (docs, odd):
        got = Counter((r.id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.link(frame).collect())
        assert got == _links([(r.doc_id, r.text) for r in frame.collect()])
    assert jaccard.link(empty).collect() == []
    assert jaccard.keep_one(odd).columns == odd.columns


def test_near_copies_of_all_degrees(spark, monkeypatch):
    """A group larger than a block, with links just above and below the threshold."""
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for at in random.integers(0, 120, random.integers(0, 4)):
            w[at] = f"x{random.integers(0, 50)}"
        rows.append((i, " ".join(w[: 120 - int(random.integers(0, 8))])))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.link(frame).collect())
    assert got == _links(rows)


def _links_at(rows, shingle, percent):
    """As `_links`, for shingles of some words and a threshold in hundredths."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()})
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    least, degree = list(range(len(rows))), Counter(x for pair in pairs for x in pair)
    for _ in rows:
        before = list(least)
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    return Counter((rows[i][0], len(sets[i]), rows[least[i]][0], degree[i]) for i in range(len(rows)))


def _near_copies(n_texts=12, seed=7):
    """Texts of all lengths with copies that are cut off, longer, or replaced in one piece or here and there."""
    random, rows = np.random.default_rng(seed), []
    for length in (3, 5, 7, 12, 30, 60, 110, 200, 400, 900)[:n_texts]:
        base = [f"w{x}" for x in random.integers(0, 3000, length)]
        rows += [base, list(base)]
        for share in (0.02, 0.05, 1 / 12, 1 / 8, 0.19, 0.21, 0.3):
            n = max(1, int(length * share))
            at = int(random.integers(0, length - n + 1))
            some = set(random.integers(0, length, max(1, n // 5)).tolist())
            rows += [base + [f"x{i}" for i in range(n)], base[:-n] or ["y"], base[:at] + [f"z{i}" for i in range(n)] + base[at + n :]]
            rows.append([f"v{i}" if i in some else w for i, w in enumerate(base)])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("shingle", "threshold"), [(5, 0.8), (1, 0.5), (3, 1.0)])
def test_jaccard_at_other_thresholds(spark, monkeypatch, shingle, threshold):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = _near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.link(frame, shingle=shingle, threshold=threshold).collect()
    assert Counter((r.id, r.n_shingles, r.component_id, r.n_links) for r in found) == _links_at(rows, shingle, round(100 * threshold))
    with pytest.raises(ValueError):
        jaccard.link(frame, threshold=0.805)


def test_pipeline_stage_links_from_five_words_and_four_fifths(spark):
    rows = _near_copies(seed=8)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, frame, FOLDER).collect()}
    assert kept == {least for _, _, least, _ in _links_at(rows, 5, 80)} != {least for _, _, least, _ in _links_at(rows, 3, 90)}


def test_many_chunks_and_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(shards, "SHARD_BYTES", 80_000)
    plan, rows = shards.layout(docs, "text"), [(r.doc_id, r.text) for r in docs.collect()]
    assert plan.chunks > 5 and plan.shard_bits > 2
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect()) == _removed(rows)
    assert sorted((r.id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_lines(docs).collect()) == _dropped(rows)
    assert Counter((r.id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.link(docs).collect()) == _links(rows)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Which one is it?\nTell me more."),
        (1, 1, "assistant", "On Monday X wrote:\n> Which one is it?\n\nThe second one."),
        (1, 2, "user", "> > which  ONE is it?\n> The second one.\nThanks"),
        (1, 3, "user", "A new question"),
        (1, 4, "assistant", ">> Tell me more.\n> something unknown\nMore"),
        (2, 0, "user", None),
        (2, None, "user", "> A new question"),
        (None, 0, "user", "x"),
        (2, 1, "user", ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv, r.turn): r for r in quotes.conversations(frame).collect()}
    assert len(got) == len(rows)
    said = {k: (r.text, r.parent, r.thread, r.depth, r.n_quoted, r.n_linked) for k, r in got.items()}
    assert said[1, 0] == ("Which one is it?\nTell me more.", None, 0, 0, 0, 0)
    assert said[1, 1] == ("The second one.", 0, 0, 1, 1, 1)
    assert said[1, 2] == ("Thanks", 1, 0, 2, 2, 2)
    assert said[1, 3] == ("A new question", None, 3, 0, 0, 0)
    assert said[1, 4] == ("More", 0, 0, 1, 2, 1)
    assert said[2, 0][0] is None and said[2, 1][0] == "" and said[2, None][1] is None
    order = [(r.conv, r.turn) for r in quotes.conversations(frame.filter("conv_id = 1")).collect()]
    assert [t for _, t in order] == [0, 1, 4, 2, 3]
    assert quotes.conversations(frame.limit(0)).collect() == []


def test_quotes_of_passages(spark):
    """Wrapped anew, cut, edited, of several messages, and foreign; the earliest of equals is the source."""
    long = "It was a bright cold day in April, and the clocks were striking thirteen"
    other = "Call me Ishmael, some years ago, never mind how long precisely, having little or no money"
    rows = [
        (1, 0, "u", long),
        (1, 1, "u", "> It was a bright cold\n> day in april and\n>the clocks were\nYes"),
        (1, 2, "u", f"{other}\n{long}"),
        (1, 3, "u", "> ago, never mind how long precisely\nA"),
        (1, 4, "u", f"> {long}\n\n> {other}\nB"),
        (1, 5, "u", "> the clocks of all the towns struck thirteen times and nobody minded it at all\nC"),
        (1, 6, "u", "> in April and\nD"),
        (1, 6, "u", "> in April and\nD"),
        (1, 7, "u", "> Yes!\n> \nE"),
        (2, 8, "u", f"> {long}\nF"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = frame.withColumns({c: F.lit("x") for c in ("conv", "version", "hash", "size", "source", "level")})
    got = {(r.conv, r.turn): (r.text, r.parent, r.n_quoted, r.n_linked) for r in quotes.conversations(clashing).collect()}
    assert got == {
        (1, 0): (long, None, 0, 0), (1, 1): ("Yes", 0, 1, 1), (1, 2): (f"{other}\n{long}", None, 0, 0), (1, 3): ("A", 2, 1, 1),
        (1, 4): ("B", 0, 2, 2), (1, 5): ("C", None, 1, 0), (1, 6): ("D", None, 1, 0), (1, 7): ("E", 1, 1, 1), (2, 8): ("F", None, 1, 0),
    }
    assert quotes.conversations(clashing).count() == len(rows)


def test_quotes_of_a_very_long_message(spark):
    text = "\n".join(f"> line {i} of a long quote" if i % 3 else f"and own {i}" for i in range(100_000))
    frame = spark.createDataFrame([(1, 0, "u", "line 1 of a long quote"), (1, 1, "u", text)], "conv_id long, turn long, role string, text string")
    row = next(r for r in quotes.conversations(frame).collect() if r.turn)
    assert (row.parent, row.n_quoted, row.text.count("\n")) == (0, 33333, 33333)


def test_pipeline_stages(spark, docs):
    now, benchmark = docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = now, stage(spark, now, FOLDER).cache()
        if name != "packing":
            assert out.columns == docs.columns
            kept = {r.doc_id for r in out.collect()}
            rows = [(r.doc_id, r.text) for r in before.collect()]
            if name == "toxicity":
                assert 0.8 * len(rows) <= len(kept)
            if name == "line_dedup":
                assert sorted((r.doc_id, r.text) for r in out.collect()) == [(d, t) for d, _, _, t in _dropped(rows)]
            if name == "jaccard_join":
                assert kept == {least for (doc, n, least, _) in _links(rows) if n} | {doc for (doc, n, _, _) in _links(rows) if not n}
            if name == "decontamination":
                assert kept == {d for d, _ in rows} - {r.id for r in decontaminate.leaks(before, benchmark).collect()}
        else:
            _check_packing([r for r in out.withColumnRenamed("doc_id", "id").collect()], [(r.doc_id, r.text) for r in before.collect()])
        now = out
