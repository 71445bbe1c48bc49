"""Language identification in two levels.

A linear support vector machine per language family picks the family; within
it, one-versus-one machines separate the languages and vote. All of them read
relative frequencies of hashed byte n-grams of the lower-cased text, so a whole
text costs one gather and one sum. The machines are fitted on a bounded sample
of labelled rows; every row of the table is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table, texts

# Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la lad oc pt rm ro sc scn",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-iranian": "as bn fa gu hi ku mr ne or pa ps sa sd si ta te tg ur",
    "semitic": "am ar he mt ti",
    "austronesian": "ceb haw id jv mg mi ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BITS = 13
ORDERS = (1, 2, 3, 4)
GAP = b"    "  # between texts: as long as the longest n-gram, so none spans two texts
PIECE = 1 << 20  # bytes of text that are hashed at once


def ngram_bins(data: np.ndarray) -> list[np.ndarray]:
    """Bins of the n-grams that start at each byte, for each order."""
    code, out = np.zeros(len(data), np.uint64), []
    for n in ORDERS:
        tail = np.zeros(len(data), np.uint64)
        tail[: len(data) - n + 1] = data[n - 1 :]
        code = code * np.uint64(257) + tail + np.uint64(1)
        out.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def pieces(lines: list[str]):
    """Runs of padded texts of about PIECE bytes: (number of the first text, bytes, start of each text)."""
    first, run, size = 0, [], 0
    for i, x in enumerate(lines):
        run.append(b" " + x.lower().encode() + GAP)
        size += len(run[-1])
        if size >= PIECE or i == len(lines) - 1:
            yield first, np.frombuffer(b"".join(run), np.uint8), np.cumsum([0] + [len(r) for r in run])[:-1]
            first, run, size = i + 1, [], 0


def project(lines: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of every text, one column for each column of weights."""
    out = np.zeros((len(lines), weights.shape[1]))
    for first, data, starts in pieces(lines):
        sums = sum(np.add.reduceat(weights[bins], starts, axis=0, dtype=np.float64) for bins in ngram_bins(data))
        lengths = np.diff(np.append(starts, len(data)))
        out[first : first + len(starts)] = sums / (len(ORDERS) * lengths)[:, None]
    return out


def frequencies(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), 1 << BITS), np.float32)
    for first, data, starts in pieces(lines):
        bins, ends = ngram_bins(data), np.append(starts, len(data))
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            out[first + i] = np.bincount(np.concatenate([x[a:b] for x in bins]), minlength=1 << BITS) / (len(ORDERS) * (b - a))
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, rounds: int = 80, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes of equal weight, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    step = 1.0 / (2 * float((share * (x**2).sum(1)).sum()) + penalty)
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - step * (penalty * look - 2 * (x.T @ (share * y * slack)))
        look = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Machines:
    """Stacked weights: a column for each family, then one for each pair of languages of a family."""

    families: list[list[str]]
    pairs: list[tuple[int, str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, lines: list[str]) -> tuple[list[str], np.ndarray]:
        margins = project(lines, self.weights) + self.bias
        chance = 1 / (1 + np.exp(-np.clip(2 * margins, -30, 30)))
        n = len(self.families)
        family = margins[:, :n].argmax(1) if n else np.zeros(len(lines), int)
        langs, scores = [], np.zeros(len(lines))
        for i, f in enumerate(family):
            votes = dict.fromkeys(self.families[f], 0.0)
            for j, (g, a, b) in enumerate(self.pairs, n):
                if g == f:
                    votes[a] += chance[i, j] + (chance[i, j] > 0.5)
                    votes[b] += 1 - chance[i, j] + (chance[i, j] <= 0.5)
            best = max(votes, key=lambda c: (votes[c], c))
            langs.append(best)
            rivals = max(1, len(votes) - 1)
            within = (votes[best] / (2 * rivals)) if len(votes) > 1 else 1.0
            scores[i] = within * (chance[i, f] if n > 1 else 1.0)
        return langs, np.clip(scores, 0, 1)


def fit(lines: list[str], langs: list[str]) -> Machines:
    """Machines for the languages of a sample. One language alone is always predicted."""
    known = sorted(set(langs))
    names = sorted({FAMILY_OF.get(c, c) for c in known})
    families = [[c for c in known if FAMILY_OF.get(c, c) == name] for name in names]
    x, y = frequencies(lines), np.array(langs)
    scale = (1 / (x.std(0) + 1e-4)).astype(np.float32)
    x *= scale / np.sqrt(len(scale))
    columns, pairs = [], []
    group = np.array([names.index(FAMILY_OF.get(c, c)) for c in langs])
    for i in range(len(names)):
        columns.append(support_vectors(x, np.where(group == i, 1, -1).astype(np.float32)) if len(names) > 1 else (np.zeros(x.shape[1]), 0.0))
    for i, members in enumerate(families):
        for a, b in combinations(members, 2):
            rows = (y == a) | (y == b)
            columns.append(support_vectors(x[rows], np.where(y[rows] == a, 1, -1).astype(np.float32)))
            pairs.append((i, a, b))
    weights = np.stack([w for w, _ in columns], 1) * (scale / np.sqrt(len(scale)))[:, None]
    return Machines(families, pairs, weights.astype(np.float32), np.array([b for _, b in columns]))


def fold(key: Column, n: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def sample_labelled(labelled: DataFrame, label: str, each: int, most: int) -> DataFrame:
    """About ``each`` rows of every label and at most ``most`` in all, chosen by a hash of doc_id."""
    counts = labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(max(1, most // 8)).collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label) == r[label], F.lit(each / max(r["count"], 1))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < share).orderBy(F.xxhash64("doc_id")).limit(most)


def train(docs: DataFrame, each: int = 700, most: int = 4000) -> Machines | None:
    """Fit on rows with text and a label: about ``each`` of every language, ``most`` in all (the documented bound)."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang")
    chosen = sample_labelled(labelled, "lang", each, most)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    found = rows.select("doc_id", "lang", "text").orderBy("doc_id", "lang", "text").limit(2 * most).collect()
    return fit([r.text for r in found], [r.lang for r in found]) if found else None


def identify(docs: DataFrame, machines: Machines | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every whole text: ``key``, ``lang_pred`` and ``score``.

    Null texts, texts without a letter and, without machines, all texts are
    ``und`` with score 0. Repeated rows and null keys stay; an empty table
    gives an empty result; only the two columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machines)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, lines = shared.value, texts(batch.column(1))
        lettered = [i for i, x in enumerate(lines) if m and any(map(str.isalpha, x))]
        langs, scores = ["und"] * len(lines), [0.0] * len(lines)
        if lettered:
            for i, lang, score in zip(lettered, *m.predict([lines[i] for i in lettered]), strict=True):
                langs[i], scores[i] = lang, float(score)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(per_batch(predict), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machines = train(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = identify(docs, machines)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
