"""Toxicity by weak supervision.

1. Lexicons. From a bounded sample of labelled training documents, words and word beginnings that
   toxic texts hold more often than others become lexicon voters; a few patterns of characters are
   voters too. A voter fires on a text or keeps silent.
2. Label model. A generative model with a hidden label: each voter fires with a probability that depends on the
   label and on the one other voter that it is correlated with most. Expectation maximisation estimates these
   accuracies and correlations from the votes, among which the label of a sampled document is one.
3. Classifier. A linear model on the presence of hashed features is trained on the posterior
   labels and scores every whole text.

Only steps 1 and 2 see the sample, `SAMPLE` documents at most, chosen by the hash of their id, one text for each; the
model is a table of `2 ** BITS` weights. Scores depend on the text alone.

Nulls: a null or empty text gets the score of a text without any feature; labels that are null
don't train. Without any toxic label, or any other, the score is the share of toxic labels, 0 if
there are none. Equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from . import text

SAMPLE = 10_000
TASKS = 16
BITS = 18
PREFIXES = (4, 5, 6)
VOTERS = 150
FEATURES = 1500
#: A lexicon voter fires so many times (as a logarithm) as often on toxic texts as on others, and
#: by chance only where this likelihood ratio statistic is reached.
LEAN, TOLD = float(np.log(8)), 20.0
ROUNDS = 50
#: Rounds in which the voters' forest is drawn anew; it stays as it is in the others.
FOREST_ROUNDS = 5
#: Voters may depend on one another from this residual correlation on.
TIED = 0.3
#: How often a label of the sample is taken to be right before any is compared with the votes, and the texts that this
#: belief counts for.
GIVEN, GIVEN_WEIGHT = 0.95, 20
PATTERNS = ("exclamations", "mixed marks", "masked letters", "stretched letters", "capitals", "mentions")

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all words and word beginnings, as often as they occur."""
    low = text.LOWER[data]
    starts, ends, bounds = text.words(data, offsets, ~_LETTERS)
    doc = text.owners(bounds)
    docs, out = [doc], [text.hashes(low, starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        docs.append(doc[long])
        out.append(text.hashes(low, starts[long], starts[long] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
    return np.concatenate(docs), (text.mix(np.concatenate(out)) >> np.uint64(64 - BITS)).astype(np.int64)


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by patterns: which of them each text holds."""
    n = len(data)
    here = np.zeros((len(PATTERNS), n), bool)
    if n > 2:
        letter, a, b, c = _LETTERS[data], data[:-2], data[1:-1], data[2:]
        low = text.LOWER[data]
        upper = (data >= 65) & (data <= 90)
        here[0, :-2] = (a == 33) & (b == 33)
        here[1, :-2] = ((a == 33) & (b == 63)) | ((a == 63) & (b == 33))
        here[2, :-2] = letter[:-2] & (b == 42) & ((c == 42) | letter[2:])
        here[3, :-2] = letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (a < 128)
        here[4, :-2] = upper[:-2] & upper[1:-1] & upper[2:]
        here[5, :-2] = (a == 64) & letter[1:-1]
    sums = np.concatenate((np.zeros((len(PATTERNS), 1), np.int64), np.cumsum(here, axis=1, dtype=np.int64)), axis=1)
    return ((sums[:, offsets[1:]] - sums[:, offsets[:-1]]) > 0).T


@dataclass(frozen=True)
class Model:
    """Weight of each bucket and pattern, and the intercept."""

    weights: np.ndarray
    pattern_weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs, found = buckets(data, offsets)
        useful = self.weights[found] != 0
        pairs = np.unique(docs[useful] << BITS | found[useful])
        z = self.intercept + np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], len(offsets) - 1)
        z = z + patterns(data, offsets) @ self.pattern_weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class LabelModel:
    """What was estimated of the hidden label and its voters.

    `parent` is the voter that each voter depends on besides the label, -1 where none does. `fired` has, for a silent
    and a firing parent, the log ratio of the odds that a voter fires on toxic and on other texts.
    """

    posterior: np.ndarray
    parent: np.ndarray
    fired: np.ndarray
    #: Shares of toxic and of other texts that the given label, as a voter, gets right.
    given_right: tuple[float, float] | None


def _dependence(x: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Twice the log likelihood ratio by which each pair of voters depends on one another within the labels."""
    out = np.zeros((x.shape[1], x.shape[1]))
    for w in weights:
        n = w.sum() + 1e-9
        both, one = x.T @ (w[:, None] * x), w @ x
        for a in (one, n - one):
            for b in (one, n - one):
                n_a, n_b = a[:, None], b[None, :]
                # Texts in which the voters are as `a` and `b` say, from the margins and the joint count.
                joint = both if a is one and b is one else n_a - both if a is one else n_b - both if b is one else n - one[:, None] - one[None, :] + both
                joint = np.maximum(joint, 0)
                expected = np.maximum(n_a * n_b / n, 1e-12)
                out += 2 * joint * np.log(np.maximum(joint, 1e-12) / expected)
    # Labels that are wrong by themselves tie all voters a little; such ties are not the voters' own.
    rest = x - sum(w[:, None] * ((w @ x) / (w.sum() + 1e-9)) for w in weights)
    spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
    out[(rest.T @ rest) / max(len(x), 1) / np.outer(spread, spread) <= TIED] = 0
    np.fill_diagonal(out, 0)
    return out


def _forest(strength: np.ndarray, least: float) -> np.ndarray:
    """The parent of each voter in the strongest spanning forest of edges over `least`; -1 for roots."""
    n = len(strength)
    parent, best, by = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -np.inf))) if (best[left] > least).any() else int(np.flatnonzero(left)[0])
        parent[i] = by[i] if best[i] > least else -1
        left[i] = False
        closer = left & (strength[i] > best)
        best[closer], by[closer] = strength[i][closer], i
    return parent


def _balanced(z: np.ndarray, share: float) -> np.ndarray:
    """Posteriors of log odds `z`, moved by what makes `share` their mean."""
    low, high = -80.0, 80.0
    for _ in range(40):
        middle = (low + high) / 2
        posterior = 1 / (1 + np.exp(-np.clip(z + middle, -40, 40)))
        low, high = (middle, high) if posterior.mean() < share else (low, middle)
    return posterior


def label_model(votes: np.ndarray, given: np.ndarray, n_lexicon: int, given_votes: bool = True) -> LabelModel:
    """A hidden label and what each voter does given it and one other voter, by expectation maximisation.

    The first `n_lexicon` voters are lexicons, patterns follow. A silent voter says nothing, since
    a lexicon is of one language, unless the voter it depends on fires; that all lexicons are silent does. As
    silence is left out, the share of toxic texts is held to that of the given labels, or firing would decide alone. Correlations are part of the model: voters form
    the forest of their strongest dependences within the labels, and a voter fires with a probability for each label
    and state of its parent, so that a word and its beginning don't count twice. `given`, the label of each
    sampled text, is one more voter whose accuracies are estimated too, starting from `GIVEN` with the weight of
    `GIVEN_WEIGHT` texts of either label; without `given_votes` only their share of toxic texts is used. A voter may turn out useless, but not speak for the other label.
    """
    x = votes.astype(np.float64)
    trusted = x[:, :n_lexicon].sum(axis=1)
    none = (trusted == 0).astype(np.float64)
    first = given == 1 if given_votes else trusted > 0
    post = np.where(first, GIVEN, 1 - GIVEN)
    prior = (given.sum() + 0.5) / (len(given) + 1)
    parent = np.full(x.shape[1], -1)
    fired, right = np.zeros((2, x.shape[1])), None
    for turn in range(ROUNDS):
        weights = (post, 1 - post)
        totals = [w.sum() for w in weights]
        if turn < FOREST_ROUNDS:
            parent = _forest(_dependence(x, weights), TOLD)
            above = np.where(parent[None, :] >= 0, x[:, parent], 0)
        shares = []
        for w, n in zip(weights, totals, strict=True):
            alone = (w @ x + 0.05) / (n + 1)
            n_above, n_both = w @ above, w @ (x * above)
            silent = (w @ x - n_both + alone) / (n - n_above + 1)
            shares.append(np.stack([silent, (n_both + alone) / (n_above + 1)]))
        fired = np.maximum(np.log(np.clip(shares[0], 1e-9, 1)) - np.log(np.clip(shares[1], 1e-9, 1)), 0)
        quiet = np.log(np.clip(1 - shares[0][1], 1e-9, 1)) - np.log(np.clip(1 - shares[1][1], 1e-9, 1))
        z = (x * np.where(above == 1, fired[1], fired[0]) + above * (1 - x) * quiet).sum(axis=1)
        z += none * (np.log((post @ none + 0.05) / (totals[0] + 1)) - np.log((weights[1] @ none + 0.05) / (totals[1] + 1)))
        if given_votes:
            right = tuple(float((w @ (given == y) + GIVEN * GIVEN_WEIGHT) / (n + GIVEN_WEIGHT)) for w, n, y in zip(weights, totals, (1, 0), strict=True))
            z += np.where(given == 1, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        new = _balanced(z, prior)
        done = turn >= FOREST_ROUNDS and np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return LabelModel(post, parent, fired, right)


def linear(x: np.ndarray, target: np.ndarray, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic regression on soft labels; both labels count alike."""
    weight = np.ones(len(target), np.float32)
    x = x.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    ahead, b_ahead, t = w, b, 1.0
    # The step is one over a bound of the curvature, by a few power iterations.
    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(20):
        v = v / np.linalg.norm(v)
        u = weight * (x @ v[:-1] + v[-1])
        v = np.append(x.T @ u, u.sum())
    step = np.float32(1 / (0.3 * float(np.linalg.norm(v)) + l2))
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ ahead + b_ahead, -40, 40))) - target).astype(np.float32)
        w_new = ahead - step * (x.T @ error + l2 * ahead)
        b_new = b_ahead - step * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = np.float32((t - 1) / t_new)
        ahead, b_ahead = w_new + momentum * (w_new - w), b_new + momentum * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b)


def _likelihood_ratio(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Twice the log likelihood ratio of two shares against one common share."""

    def log_likelihood(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (k1 + k0) / (n1 + n0)
    return 2 * (log_likelihood(k1, n1, k1 / n1) + log_likelihood(k0, n0, k0 / n0) - log_likelihood(k1, n1, both) - log_likelihood(k0, n0, both))


def _frequencies(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """[other, toxic] documents that hold each bucket and pattern; and how many there are."""
    size = (1 << BITS) + len(PATTERNS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = text.text_bytes(part.column(0))
                label = text.longs(part.column(1))
                docs, found = buckets(data, offsets)
                pairs = np.unique(docs << BITS | found)
                of, bucket = label[pairs >> BITS], pairs & ((1 << BITS) - 1)
                held = patterns(data, offsets)
                for y in (0, 1):
                    sums[y, : 1 << BITS] += np.bincount(bucket[of == y], minlength=1 << BITS)
                    sums[y, 1 << BITS :] += held[label == y].sum(axis=0)
                    n[y] += int((label == y).sum())
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<i4").tobytes()], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64()))], ["sums", "n"])

    total, n = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
    # One row of 2 MB for each of `TASKS` tasks.
    told = sample.mapInArrow(count, "sums binary, n array<long>").toArrow()
    for sums, counted in zip(told.column("sums"), told.column("n"), strict=True):
        total += np.frombuffer(sums.as_buffer(), "<i4").reshape(2, size)
        n += np.array(counted.as_py())
    return total, n


def _held(sample: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents by chosen buckets and all patterns: which they hold, their labels)."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = sample.sparkSession.sparkContext.broadcast(place)
    width = len(chosen) + len(PATTERNS)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_ = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = text.text_bytes(part.column(0))
                docs, found = buckets(data, offsets)
                out = np.zeros((len(offsets) - 1, width), bool)
                known = at_[found]
                out[docs[known >= 0], known[known >= 0]] = True
                out[:, width - len(PATTERNS) :] = patterns(data, offsets)
                packed = np.packbits(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in packed], pa.binary()), part.column(1)], ["bits", "label"])

    rows = sample.mapInArrow(hold, "bits binary, label int").collect()
    packed = np.frombuffer(b"".join(row["bits"] for row in rows), np.uint8).reshape(len(rows), -(-width // 8))
    return np.unpackbits(packed, axis=1, count=width), np.array([row["label"] for row in rows])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE) -> DataFrame:
    """(text, label) of at most `rows` labelled documents, the first by the hash of their id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # At most `rows` rows of 12 bytes. An id that rows share counts once, with the greatest of their texts.
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label")).select("text", "label").repartition(TASKS)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE, given_votes: bool = True
) -> Model:
    """A model from the labelled rows that are given; hold rows out before.

    Without `given_votes` labels choose the lexicons only, and the hidden label is found from the votes of lexicons and patterns.
    """
    sample = training_sample(docs, labels, id_col, text_col, label_col, rows)
    counts, n = _frequencies(sample)
    none = Model(np.zeros(1 << BITS, np.float32), np.zeros(len(PATTERNS), np.float32), -40.0 if n[1] == 0 else 40.0)
    if n.min() == 0:
        return none
    other, toxic = counts[:, : 1 << BITS]
    lean = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((other + 0.5) / (n[0] + 1))
    told = _likelihood_ratio(toxic, n[1], other, n[0])
    lexicon = np.argsort(-np.where(lean > LEAN, told, 0), kind="stable")[:VOTERS]
    lexicon = lexicon[(lean[lexicon] > LEAN) & (told[lexicon] > TOLD)]
    chosen = np.unique(np.concatenate((lexicon, np.argsort(-told, kind="stable")[:FEATURES])))
    held, given = _held(sample, chosen)
    voters = np.concatenate((np.searchsorted(chosen, lexicon), np.arange(len(chosen), held.shape[1])))
    told_by = label_model(held[:, voters], given, len(lexicon), given_votes)
    w, b = linear(held, told_by.posterior)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w[: len(chosen)]
    return Model(weights, w[len(chosen) :], b)


def score(docs: DataFrame, model: Model, text_col: str = "text", keys: dict[str, Column] | None = None) -> DataFrame:
    """`keys` of each document, score and predicted."""
    keys = keys or {}
    names = list(keys)
    source = docs.select(*(c.alias(name) for name, c in keys.items()), F.col(text_col).alias("_text"))
    schema = StructType(source.schema.fields[:-1]).add("score", DoubleType()).add("predicted", IntegerType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = shared.value.scores(*text.text_bytes(part.column(len(names))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(names))] + [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
                    [*names, "score", "predicted"],
                )

    return source.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic."""
    columns = docs.columns
    keys = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}
    kept = score(docs, model, text_col, keys).filter("predicted = 0")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
