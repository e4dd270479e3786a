"""Quality rules whose cutoffs follow the data.

Per language and source, a mergeable quantile sketch of each measure is built over all documents: a
histogram whose bins are 1/128 of their value wide, so that it is small, has a bounded relative error,
and depends on the documents alone, not on how they are dealt to tasks. Sketches merge by adding counts.
A cutoff lies beyond the upper (or lower) quartile by a multiple of the spread of the middle half. Where
that is next to nothing, the spread is what one occurrence makes in the group's median document, so the
cutoff follows its length. The cutoffs of a language are drawn towards those of all documents, and those
of a source towards its language's, by the weight of `PRIOR` documents; no source's cutoff is looser
than its language's, so a source of junk can't raise its own. The cutoffs, a few rows, are joined to the
documents by language and source, and what lies beyond any of them goes.

Nulls: a null text has no words and fails the base rules; a null language or source is a group of
its own. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir
from . import text

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WORDS = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Measure, how it is taken, which side is bad, and what one occurrence adds to the count above the
#: stroke: a symbol, a line, the words of the shortest repeat and what it repeats, a letter.
MEASURES: dict[str, tuple[str, str, int]] = {
    "symbols_per_word": ("n_symbols / n_words", "high", 1),
    "dup_line_share": ("n_dup_lines / n_lines", "high", 1),
    "repeat_share": ("n_repeat_words / n_words", "high", 2 * REPEAT_WORDS),
    "mean_word_long": ("word_chars / n_words", "high", 1),
    "mean_word_short": ("word_chars / n_words", "low", 1),
}
SIZES = ("n_words", "n_lines")
#: Bits of a measure (in millionths) that its bin keeps.
BIN_BITS = 8
#: Documents that the wider group's cutoffs count for.
PRIOR = 200
SPREADS = 3.0


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text of a batch."""
    starts, ends, bounds = text.words(data, offsets)
    space = text.SPACE[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    h, doc = text.hashes(data, starts, ends), text.owners(bounds)
    at = text.gram_starts(bounds, REPEAT_WORDS)
    twice = _repeated(text.grams(h, at, REPEAT_WORDS), doc[at])[0]
    inside = np.concatenate(([0], np.cumsum(text.covered(at[twice], REPEAT_WORDS, len(h)))))

    first, last, line_bounds = text.lines(data, offsets)
    words_before = np.searchsorted(starts, np.append(first, len(data)))
    filled = np.searchsorted(starts, last) > words_before[:-1]
    line_doc = text.owners(line_bounds)
    later = np.zeros(len(first), np.int64)
    later[filled] = _repeated(text.hashes(data, first, last)[filled], line_doc[filled])[1]
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~space),
        "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_doc, later, len(offsets) - 1).astype(np.int64),
        "n_repeat_words": inside[bounds[1:]] - inside[bounds[:-1]],
        "n_lines": np.bincount(line_doc, filled, len(offsets) - 1).astype(np.int64),
    }


def _repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stands twice or more in its text, stood before in its text)."""
    key = text.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    first = text.runs(key[order])
    sizes = np.diff(np.append(first, len(key)))
    several, later = np.empty(len(key), bool), np.ones(len(key), bool)
    several[order] = np.repeat(sizes > 1, sizes)
    later[order[first]] = False
    return several, later


def measured(docs: DataFrame, text_col: str = "text", keys: dict[str, Column] | None = None) -> DataFrame:
    """`keys` of each document and the counts of its whole text."""
    keys = keys or {}
    names = list(keys)
    source = docs.select(*(c.alias(name) for name, c in keys.items()), F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{c} long" for c in COUNTS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = counts(*text.text_bytes(part.column(len(names))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(names))] + [pa.array(found[c], pa.int64()) for c in COUNTS], [*names, *COUNTS]
                )

    return source.mapInArrow(measure, schema)


def _measure(rule: str) -> Column:
    top, bottom = MEASURES[rule][0].split(" / ")
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _bin(measure: Column) -> Column:
    """The least number of a measure's bin, in millionths."""
    micro = F.greatest(F.floor(measure * 1_000_000).cast("long"), F.lit(0))
    bits = F.greatest(F.length(F.bin(micro)) - BIN_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", micro, bits), bits)


def sketches(rows: DataFrame, path: str) -> DataFrame:
    """(lang, source, measure, bin, n) of all documents, written once; their sum over any groups is the sketch of those."""
    measures = {m: _measure(m) for m in MEASURES} | {c: F.col(c) for c in SIZES}
    bins = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _bin(c).alias("bin")) for m, c in measures.items()))).alias("b")
    rows.select("lang", "source", bins).groupBy("lang", "source", "b.measure", "b.bin").agg(F.count("*").alias("n")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by.., measure, n, q25, q50, q75): the least bin up to which that share of the documents lies."""
    group = Window.partitionBy(*by, "measure")
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    # A group has some thousand bins at most, whatever its documents.
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)})
    at = [F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bin") / 1_000_000)).alias(f"q{q}") for q in (25, 50, 75)]
    return ranked.groupBy(*by, "measure").agg(F.first("total").alias("n"), *at)


def _limits(sketch: DataFrame, *by: str) -> DataFrame:
    """(by.., n, limits): the cutoff of each measure by the group's own sketch."""
    wide = quantiles(sketch, *by).groupBy(*by).agg(
        F.max("n").alias("n"),
        *(F.max(F.when(F.col("measure") == m, F.struct("q25", "q50", "q75"))).alias(m) for m in [*MEASURES, *SIZES]),
    )
    out = []
    for name, (formula, side, one) in MEASURES.items():
        low, high, size = F.col(f"{name}.q25"), F.col(f"{name}.q75"), F.col(formula.split(" / ")[1] + ".q50")
        beyond = SPREADS * F.greatest(high - low, one / F.greatest(size, F.lit(1.0)))
        out.append((high + beyond if side == "high" else low - beyond).alias(name))
    return wide.filter("n > 0").select(*by, "n", F.struct(*out).alias("limits"))


def _towards(own: Column, n: Column, wider: Column, strict: bool) -> Column:
    """Cutoffs of n documents drawn towards those of the wider group, and no looser than these if `strict`."""
    out = []
    for m, (_, side, _) in MEASURES.items():
        least = (F.least if side == "high" else F.greatest)(own[m], wider[m]) if strict else own[m]
        out.append(((n * least + PRIOR * wider[m]) / (n + PRIOR)).alias(m))
    return F.struct(*out)


def cutoffs(rows: DataFrame) -> DataFrame:
    """(lang, source, limits): one cutoff for each measure and group."""
    sketch = sketches(rows, work_dir(rows.sparkSession, "sketches"))
    # One row of numbers; none where there are no documents.
    every = _limits(sketch).first()
    overall = F.struct(*(F.lit(every["limits"][m] if every else None).cast("double").alias(m) for m in MEASURES))
    language = _limits(sketch, "lang").select("lang", _towards(F.col("limits"), F.col("n"), overall, strict=False).alias("wider"))
    own, language = _limits(sketch, "lang", "source").alias("own"), language.alias("language")
    joined = own.join(language, F.col("own.lang").eqNullSafe(F.col("language.lang")), "left")
    return joined.select("own.lang", "own.source", _towards(F.col("own.limits"), F.col("own.n"), F.col("wider"), strict=True).alias("limits"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(rows: DataFrame) -> DataFrame:
    """Measured rows with lang and source, plus base_failed and kept; texts are measured once, their counts written."""
    path = work_dir(rows.sparkSession, "counts")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    limits = cutoffs(rows).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "limits")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    within = [
        _measure(m) <= F.col(f"limits.{m}") if side == "high" else _measure(m) >= F.col(f"limits.{m}") for m, (_, side, _) in MEASURES.items()
    ]
    verdict = within[0]
    for other in within[1:]:
        verdict = verdict & other
    judged = rows.join(limits, same, "left").withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict, F.lit(True))).drop("_lang", "_source", "limits")
