"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Their accuracies (for each class, how often a
vote is bad) are estimated without any true label by expectation-maximisation over the counts of vote patterns, of which there
are at most 3 ** (number of labellers), whatever the size of the corpus. Abstaining says nothing about the class. Each labeller
looks for one kind of junk, so in most bad documents most of them vote good; what the model may assume is that they seldom
accuse good text. That is a prior on the rate of false alarms, weighing as much as the corpus: it decides what the two classes are. It
also draws the rates it is about towards itself, so once the classes have settled, ``rates`` are counted from them without it. The
posterior of each pattern labels a bounded sample, on which a linear scorer over hashed features is trained; the scorer judges every
document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import free_name, ship_by_value, small_batches, with_arrow_column
from cohortry.sources.scratch import keep

ship_by_value(__name__)

ABSTAIN, GOOD, BAD = 0, 1, 2
SAMPLE_ROWS = 4096  # distinct documents the scorer is fitted on; counts for the label model cover all documents
BUCKETS_LOG2 = 11
STEPS, RATE, MOMENTUM, PENALTY = 300, 0.5, 0.95, 1e-5
CUT = 0.5
FALSE_ALARMS = 0.002  # prior rate of bad votes on good documents

# Byte classes.
SYMBOLS = b"!$%&*#|@^~"
UPPER, LOWER = slice(65, 91), slice(97, 123)

# Scripts written without blanks between words: Thai to Myanmar, Khmer, Tai, Balinese, Javanese, kana, Han, Yi, full and half width.
UNSPACED = re.compile(
    "[\u0e00-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u2e80-\u312f\u3190-\ua4cf\ua980-\ua9ff"
    "\uaa60-\uaadf\uf900-\ufaff\uff00-\uff9f\U00020000-\U0003ffff]+"
)
WINDOW_WORDS = 1000  # the share of new words falls with length in any prose: it is taken within stretches of so many words
SPAN_WORDS = 5  # across stretches, repetition is repeated spans of so many words
MOST_UNSPACED = 0.1  # share of the characters above which the length of words says nothing

#: Name, statistic, good below, bad above, and the least number of words to vote at all.
LABELLERS = [
    ("shouting", "upper", 0.12, 0.2, 8),
    ("symbols", "symbol", 0.01, 0.03, 3),
    ("exclaiming", "exclaim", 0.1, 0.3, 5),
    ("tables", "bar", 0.03, 0.1, 5),
    ("stuttering", "repeat", 0.04, 0.12, 10),
    ("poor in words", "poor", 0.65, 0.8, 60),
    ("odd word length", "odd_length", 4.5, 7.0, 20),
]


def statistics(text: str) -> tuple[dict[str, float], np.ndarray]:
    """Shares that the labellers look at, and the bytes of the text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    words = text.split()
    n = len(words)
    some = max(1, n)
    upper, lower = int(seen[UPPER].sum()), int(seen[LOWER].sum())
    return {
        "n": n,
        "upper": upper / max(1, upper + lower),
        "symbol": int(seen[list(SYMBOLS)].sum()) / max(1, len(raw)),
        "exclaim": int(seen[33]) / some,
        "bar": int(seen[124]) / some,
        "repeat": sum(map(eq, words, islice(words, 1, None))) / some,
        "poor": _poor(words),
        "odd_length": _odd_length(text, len(raw), some),
    }, raw


def _poor(words: list[str]) -> float:
    """Share of words seen before in their stretch of the text, or of spans seen before in the whole text if that is more."""
    n = len(words)
    within = 1 - sum(len(set(words[i : i + WINDOW_WORDS])) for i in range(0, n, WINDOW_WORDS)) / max(1, n)
    if n <= WINDOW_WORDS:
        return within
    spans = set(map(hash, zip(*[islice(words, i, None) for i in range(SPAN_WORDS)])))
    return max(within, 1 - len(spans) / (n - SPAN_WORDS + 1))


def _odd_length(text: str, size: int, words: int) -> float:
    """Distance of the mean characters a word, its blank included, from 7; no number, which abstains, in scripts without blanks."""
    apart = 0 if size == len(text) else sum(map(len, UNSPACED.findall(text)))
    return float("nan") if apart > MOST_UNSPACED * len(text) else abs((len(text) - apart) / words - 7.0)


def pattern_of(stats: dict[str, float]) -> int:
    """All votes on a document as one number in base 3; -1 for a text without words."""
    if not stats["n"]:
        return -1
    code = 0
    for _, name, good, bad, least in LABELLERS:
        x = stats[name]
        vote = ABSTAIN if stats["n"] < least else BAD if x > bad else GOOD if x < good else ABSTAIN
        code = 3 * code + vote
    return code


def votes_of(pattern: np.ndarray) -> np.ndarray:
    """Matrix of votes, one column a labeller."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return (np.asarray(pattern)[:, None] // powers[None, :]) % 3


def hashed_features(stats: dict[str, float], raw: np.ndarray) -> np.ndarray:
    """Square roots of the byte trigram frequencies in hashed buckets, and one bucket for each tenth of each statistic."""
    size, shift = 1 << BUCKETS_LOG2, np.uint32(32 - BUCKETS_LOG2)
    out = np.zeros(size, np.float32)
    if len(raw) > 2:
        b = raw.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        n = np.bincount((code * np.uint32(2654435761)) >> shift, minlength=size)
        out += np.sqrt(n / (len(raw) - 2)).astype(np.float32)
    for i, name in enumerate(("upper", "symbol", "exclaim", "bar", "repeat", "poor")):
        tenth = min(10, int(stats[name] * 10 + 1e-9)) if stats["n"] >= 10 else 11
        out[(1_000_003 * (i + 1) + 7919 * tenth) * 2654435761 % 2**32 >> int(shift)] += 0.5
    return out


@dataclass
class LabelModel:
    """P(bad), and for each class (0 good, 1 bad) and labeller the share of bad votes among its votes.

    ``accuses`` holds the shares that posteriors are formed with, the prior on false alarms included; ``rates`` the shares that these
    posteriors find in the votes, without it.
    """

    prior: float
    accuses: np.ndarray
    rates: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) of vote patterns."""
        v = votes_of(pattern)
        good, bad = (((v == BAD) * np.log(a) + (v == GOOD) * np.log1p(-a)).sum(axis=1) for a in self.accuses)
        return 1 / (1 + np.exp(np.clip(bad - good + np.log(self.prior / (1 - self.prior)), -700, 700)))


def fit_label_model(pattern: np.ndarray, counts: np.ndarray, tolerance: float = 1e-7, most: int = 50_000) -> LabelModel:
    """Expectation-maximisation over pattern counts."""
    n, v = counts.astype(float), votes_of(pattern)
    accuse, acquit = (v == BAD).astype(float), (v == GOOD).astype(float)
    start = np.repeat([[FALSE_ALARMS], [0.4]], len(LABELLERS), axis=1)
    model = LabelModel(0.1, start, start)
    for _ in range(most):
        good = model.posterior(pattern)
        weights = np.stack([good * n, (1 - good) * n])
        bad_votes, good_votes = weights @ accuse + 0.5, weights @ acquit + 0.5
        rates = bad_votes / (bad_votes + good_votes)
        bad_votes[0] += FALSE_ALARMS * n.sum()
        good_votes[0] += (1 - FALSE_ALARMS) * n.sum()
        after = LabelModel((weights[1].sum() + 0.5) / (n.sum() + 1), bad_votes / (bad_votes + good_votes), rates)
        moved = max(abs(after.prior - model.prior), float(np.abs(after.accuses - model.accuses).max()))
        model = after
        if moved < tolerance:
            return model
    raise RuntimeError(f"the label model did not settle within {most} steps")


def fit_scorer(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        ahead = (w + MOMENTUM * speed).astype(x.dtype)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = (x.T @ (p - bad).astype(x.dtype)) / len(x) + PENALTY * ahead
        speed = MOMENTUM * speed - RATE * slope
        w = w + speed
    return w


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def judge(self, text: str | None) -> tuple[int, float, float]:
        """Vote pattern, P(good) by the label model, P(good) by the scorer. A text without words scores 0."""
        stats, raw = statistics(text or "")
        pattern = pattern_of(stats)
        if pattern < 0:
            return pattern, 0.0, 0.0
        z = float(hashed_features(stats, raw).astype(float) @ self.weights[:-1] + self.weights[-1])
        return pattern, float(self.labels.posterior(np.array([pattern]))[0]), 1 / (1 + float(np.exp(np.clip(z, -700, 700))))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        found = [pattern_of(statistics(t or "")[0]) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], names=["h", "pattern"])


def _hash(docs: DataFrame, text_col: str) -> Column:
    return F.xxhash64(F.lit(6), F.col(f"`{text_col}`"))


def fit(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Fit both models. None if no document has a word."""
    text = F.col(f"`{text_col}`")
    votes = keep(docs.select(_hash(docs, text_col).alias("h"), text.alias("text")).mapInArrow(_patterns, "h long, pattern int"))
    votes = votes.filter("pattern >= 0")
    rows = votes.groupBy("pattern").count().orderBy("pattern").collect()
    if not rows:
        return None
    labels = fit_label_model(np.array([r["pattern"] for r in rows]), np.array([r["count"] for r in rows]))
    cut = votes.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    chosen = docs.select(_hash(docs, text_col).alias("h"), text.alias("text")).filter(F.col("h") <= cut)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h, *statistics(t or "")) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            found = [(h, p, hashed_features(s, raw).tobytes()) for h, s, raw in found if (p := pattern_of(s)) >= 0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array(labels.posterior(np.array([x[1] for x in found], np.int64)), pa.float64()),
                    pa.array([x[2] for x in found], pa.binary()),
                ],
                names=["h", "good", "x"],
            )

    def train(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("h").to_numpy())
        x = np.stack([np.frombuffer(v, np.float32) for v in table.column("x").to_pylist()])[order]
        w = fit_scorer(x, 1 - table.column("good").to_numpy()[order])
        return pa.table({"w": pa.array([w.tobytes()], pa.binary())})

    sample = chosen.groupBy("h").agg(F.first("text").alias("text")).mapInArrow(featured, "h long, good double, x binary")
    weights = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "w binary").first()["w"]
    return QualityModel(labels, np.frombuffer(weights))


JUDGED = T.StructType(
    [
        T.StructField("pattern", T.IntegerType()),
        T.StructField("label_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("keep", T.BooleanType()),
    ]
)


def judged(docs: DataFrame, name: str, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with a struct column ``name``: pattern, label_score, score, keep.

    Fits on the table itself. Null, empty and blank texts have pattern -1, score 0 and are rejected. Every row is judged by
    its text alone: repeated rows get equal results, null ids and other columns pass through unread. Of equal texts the
    fitting sample takes one. An empty table gives an empty result.
    """
    model = fit(docs, text_col, sample_rows)
    kind = pa.struct([("pattern", pa.int32()), ("label_score", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def compute(cols: list[pa.Array]) -> pa.Array:
        out = [model.judge(t) if model else (-1, 0.0, 0.0) for t in cols[0].to_pylist()]
        return pa.array([{"pattern": p, "label_score": a, "score": s, "keep": s >= CUT} for p, a, s in out], kind)

    return with_arrow_column(docs, [F.col(f"`{text_col}`")], lambda: compute, T.StructField(name, JUDGED))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, ``votes`` (one letter a labeller: g, b or -), ``label_score``, ``score`` and ``keep``."""
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    digits = F.lpad(F.conv(F.col("q.pattern").cast("string"), 10, 3), len(LABELLERS), "0")
    return judged(two, "q", "text", sample_rows).select(
        F.col("id").alias(id_col),
        F.when(F.col("q.pattern") >= 0, F.translate(digits, "012", "-gb")).alias("votes"),
        F.col("q.label_score").alias("label_score"),
        F.col("q.score").alias("score"),
        F.col("q.keep").alias("keep"),
    )


def accepted(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents the classifier keeps: whole rows, same columns."""
    name = free_name(docs.columns, "_quality")
    return judged(docs, name, text_col, sample_rows).filter(F.col(f"`{name}`.keep")).drop(name)
