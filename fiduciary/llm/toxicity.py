"""Toxicity by weak supervision.

Voters are lexicon words, word beginnings and word ends that a sample of
labelled rows shows far more often in toxic texts. A generative model with
latent labels estimates how accurate every voter is (expectation maximisation)
and how the voters' errors correlate, and discounts voters that repeat each
other. Its posterior labels train a logistic regression on the votes, which
scores every whole text of the table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, per_batch, table, texts
from .langid import fold, sample_labelled

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W_]*[0-9@$!][\w@$!]*")  # a word with figures or signs in place of letters
UNMASK = str.maketrans("013457@$!", "oieastasi")
ENDS = (4, 5)  # lengths of word beginnings and ends that can vote
SHORTEST, LONGEST = 3, 24


def signs(text: str) -> set[str]:
    """What a text can vote with: its words, their beginnings ("abcd*") and their ends ("*abcd")."""
    low = text.lower()
    found = set(WORD.findall(low))
    found.update(w for x in MASKED.findall(low) if (w := x.translate(UNMASK)).isalpha())
    words = {w for w in found if SHORTEST <= len(w) <= LONGEST}
    out = set(words)
    for n in ENDS:
        out.update([f"{w[:n]}*" for w in found if len(w) > n])
        out.update([f"*{w[-n:]}" for w in found if len(w) > n])
    return out


@dataclass
class Voters:
    """The voters by kind, so that a text's words are looked up in bulk."""

    names: list[str]
    words: dict[str, int] = field(default_factory=dict)
    starts: dict[int, dict[str, int]] = field(default_factory=dict)
    ends: dict[int, dict[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, x in enumerate(self.names):
            if x.endswith("*"):
                self.starts.setdefault(len(x) - 1, {})[x[:-1]] = i
            elif x.startswith("*"):
                self.ends.setdefault(len(x) - 1, {})[x[1:]] = i
            else:
                self.words[x] = i

    def votes(self, text: str) -> list[int]:
        low = text.lower()
        found = set(WORD.findall(low))
        found.update(w for x in MASKED.findall(low) if (w := x.translate(UNMASK)).isalpha())
        out = [self.words[w] for w in found & self.words.keys()]
        for n, known in self.starts.items():
            out += [known[x] for x in {w[:n] for w in found if len(w) > n} & known.keys()]
        for n, known in self.ends.items():
            out += [known[x] for x in {w[-n:] for w in found if len(w) > n} & known.keys()]
        return sorted(out)


def label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior chance of the toxic class for every row of a votes matrix (0 or 1).

    The labels given are one more voter of unknown accuracy. Rows count by
    ``weight``. The correlation of two voters is that of their residuals given
    the latent class; a voter's evidence is divided by one plus what its
    correlations with the others have over 0.3.
    """
    all_votes = np.hstack([votes, labels[:, None]]).astype(np.float64)
    q = np.where(labels > 0, 0.9, 0.1)
    for k in range(rounds):
        pos, neg = weight * q, weight * (1 - q)
        fires = (pos @ all_votes + 0.5) / (pos.sum() + 1)
        fires_not = (neg @ all_votes + 0.5) / (neg.sum() + 1)
        if k % 5 == 0:
            rest = (all_votes - np.outer(q, fires) - np.outer(1 - q, fires_not)) * np.sqrt(weight)[:, None]
            size = np.sqrt((rest**2).sum(0)) + 1e-9
            tied = np.maximum(0, (rest.T @ rest) / np.outer(size, size) - 0.3)
            np.fill_diagonal(tied, 0)
            discount = 1 / (1 + tied.sum(1))
        on, off = np.log(fires / fires_not) * discount, np.log((1 - fires) / (1 - fires_not)) * discount
        logit = np.log(pos.sum() / neg.sum()) + all_votes @ (on - off) + off.sum()
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def logistic(x: np.ndarray, q: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, share = np.zeros(x.shape[1]), weight / weight.sum()
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - q)) + ridge * w
        curve = (x * (share * (p * (1 - p) + 1e-4))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Toxicity:
    voters: Voters
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        votes = self.voters.votes(text)
        logit = self.bias + sum(self.weights[i] for i in votes)
        if votes:
            logit += self.weights[-2] * np.log(len(votes)) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a part of the sample: how many toxic and clean texts have each sign."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(signs(text))
    names = sorted(toxic.keys() | clean.keys())
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], ["sign", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, each: int = 6000, voters: int = 300) -> Toxicity | None:
    """Fit on labelled rows: about ``each`` of both classes (the documented bound), at most ``voters`` voters.

    A label that is null doesn't count; a document labelled twice is toxic if
    one of its labels says so.
    """
    labelled = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    true = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not true.get(0) or not true.get(1):
        return None
    chosen = sample_labelled(labelled, "toxic", each, 2 * each + 1000)
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = cut(sample)
    sums = sample.mapInArrow(counted, "sign string, toxic long, clean long").groupBy("sign").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = totals.a, totals.n - totals.a
    if not n_toxic or not n_clean:
        return None
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    least = F.log(a / (n_toxic + 1)) - F.log(b / (n_clean + 1)) - 1.64 * F.sqrt(1 / a + 1 / b)
    ranked = sums.where(F.col("a") >= max(3, n_toxic // 500)).withColumn("least", least).where("least > 1.5")
    names = [r.sign for r in ranked.orderBy(F.desc(F.col("least")), "sign").limit(voters).collect()]
    if not names:
        return None
    lexicon = Voters(names)

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lexicon.votes(x) for x in texts(batch.column(0))], pa.list_(pa.int32())), batch.column(1)], ["votes", "toxic"])

    rows = sample.mapInArrow(per_batch(vote), "votes array<int>, toxic int").groupBy("votes", "toxic").count().orderBy("votes", "toxic").collect()
    matrix, y = np.zeros((len(rows), len(names))), np.array([r.toxic for r in rows])
    for i, r in enumerate(rows):
        matrix[i, r.votes] = 1
    size = np.array([r["count"] for r in rows], float)
    weight = size * np.where(y > 0, true[1] / n_toxic, true[0] / n_clean)  # as common as in the whole table
    weight *= size.sum() / weight.sum()
    q = label_model(matrix, y, weight)
    n = matrix.sum(1)[:, None]
    w, bias = logistic(np.hstack([matrix, np.log(np.maximum(n, 1)), n > 0]), q, weight)
    return Toxicity(lexicon, w, bias)


def toxicity(docs: DataFrame, model: Toxicity | None, keep: Sequence[str] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row, and the score of its whole text in the column ``name``.

    Null and empty texts get the score of a text without votes; without a model
    all scores are 0. Repeated rows and null keys stay; an empty table gives an
    empty result; no other columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = list(dict.fromkeys([*keep, text]))
    at = read.index(text)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        scores = [m.score(x) if m else 0.0 for x in texts(batch.column(at))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, name])

    kinds = StructType([StructField(c, docs.schema[c].dataType) for c in keep] + [StructField(name, DoubleType())])
    return docs.select(*read).mapInArrow(per_batch(score), kinds)


def fitted(docs: DataFrame, spark: SparkSession, sf_dir: str) -> Toxicity | None:
    """The production model: labels of the fold that is held out (remainder 2 of 4) are not read."""
    return train(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, fitted(docs, spark, sf_dir))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
