"""URL filter: rules first, logistic regression on hashed character n-grams for the rest.

DataFrame and SQL functions only. Host and path are cut from the url, rules of (host, path) judge
what they fit, and a logistic regression over character n-grams of host and path, hashed to a
fixed number of columns, judges the others. It learns from a small table of labelled urls: those
that a rule judges, at most `TRAIN_ROWS` of them, chosen by the hash of the url.

Nulls: a null url, or one without `://`, has an empty host and path and no n-grams, so the
intercept judges it. Without labelled urls everything that no rule fits is allowed. Equal urls
get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, start of the path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
TRAIN_ROWS = 20_000
FEATURES = 1 << 14
GRAMS = (3, 4)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column) -> Column:
    """Marked n-grams: where the host ends and the path begins counts."""

    def marked(mark: str, part: Column, n: int) -> Column:
        text = F.when(part != "", F.concat(F.lit("^"), part, F.lit("$"))).otherwise(F.lit(""))
        at = F.sequence(F.lit(1), F.length(text) - (n - 1))
        grams = F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*(marked(mark, part, n) for mark, part in (("h", host), ("p", path)) for n in GRAMS))


def _features(frame: DataFrame) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True).transform(
        frame.withColumn("_grams", ngrams(F.col("host"), F.col("path")))
    )


def labelled(urls: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The small labelled table: (host, path, label) of urls that a rule judges, 1 for block."""
    known = urls.filter("verdict is not null").select("host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)


def judge(pages: DataFrame, url_col: str = "url", keys: dict[str, Column] | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """`keys` of each page, host, path, rule, verdict and the model's score for block."""
    keys = keys or {}
    host, path = parts(F.col(url_col))
    cut = pages.select(*(c.alias(name) for name, c in keys.items()), host.alias("host"), path.alias("path"))
    rule, said = by_rule(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumns({"rule": rule, "verdict": said})
    train = _features(labelled(ruled))
    seen = [r["label"] for r in train.select("label").distinct().collect()]
    if len(seen) == 2:
        model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=1e-3, maxIter=50, predictionCol="_p", rawPredictionCol="_r", probabilityCol="_probability").fit(train)
        scored = model.transform(_features(ruled)).withColumn("score", vector_to_array("_probability")[1])
    else:
        scored = ruled.withColumn("score", F.lit(float(seen[0]) if seen else 0.0))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*keys, "host", "path", "rule", verdict.alias("verdict"), "score")
