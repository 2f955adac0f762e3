"""Toxicity as an ordinal grade: a cumulative-link (proportional odds) model over sparse text features.

Grades run from 0 (not toxic) to 3. Labels say toxic or not; the grade of a toxic training document is the third, by rank
among the toxic ones, of its burden: the sum of log(1 + count) over the words whose smoothed log odds for toxic documents are
at least 2. The model is P(grade <= k) = sigmoid(threshold_k - w x) with one weight vector for all three ordered thresholds, so
what it learns about any grade moves all of them. x holds log(1 + count) * idf of hashed words (letters, digits and characters
beyond ASCII, A-Z lowered) and of their first four, five and six bytes. Only words that tell the labels apart beyond chance
(chi-square) carry a weight, under an L1 penalty, so wrong labels aren't learned by heart and long clean texts gather nothing.

It is fitted on the ``sample`` labelled documents with the smallest hashed ids, a bound that keeps the fit on the driver small at
any corpus size; every document is scored, in its row, over its whole text. The output is the chance of each grade, the expected
grade as ``severity``, and ``rejected`` where toxic grades together are likelier than not and the text's words speak for them.

A null or empty text has no features and gets the grade that absent words imply. Without labelled documents of both kinds
nothing can be learned: severity is 0 and nothing is rejected. Label rows without a label or id are left out; a document with
several labels counts as toxic if one says so. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girthline.llm import bytewords as B
from girthline.session import cut

BINS, GRADES, SAMPLE = 1 << 18, 4, 6000
STEPS, RATE, L1, SIGNIFICANT = 1500, 0.1, 4e-5, 25.0
#: Documents that must have a feature before it counts.
LEAST = 3
#: Beginnings of words that are features besides the words, in bytes: they hold for forms that no label has shown.
STEMS = (4, 5, 6)


def _bins(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature bins of all words of the texts, one row for each word: the word, then its beginnings (-1 if it has none of a
    length); and for each text where its words begin."""
    starts, ends, first = B.words(data, at, B.ALPHANUMERIC)
    columns = [B.span_hashes(data, starts, ends, True) & np.uint64(BINS - 1)]
    for n in STEMS:
        hashed = B.mix(B.span_hashes(data, starts, np.minimum(starts + n, ends), True) + np.uint64(n)) & np.uint64(BINS - 1)
        columns.append(np.where(ends - starts > n, hashed, np.uint64(0xFFFFFFFFFFFFFFFF)))
    return np.stack(columns, axis=1).view(np.int64), first


def _counts(text: pa.Array):
    """For each text its distinct bins and how often each occurs."""
    for data, at in B.slices(text):
        bins, first = _bins(data, at)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            here = bins[lo:hi].ravel()
            yield np.unique(here[here >= 0], return_counts=True)


FEATURES = T.StructType([T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(FEATURES)
def features(text: pa.Array) -> pa.Array:
    found = list(_counts(text))
    return pa.StructArray.from_arrays(
        [B.lists([x.astype(np.int32) for x, _ in found], pa.int32()), B.lists([x.astype(np.int32) for _, x in found], pa.int32())], names=["bins", "counts"]
    )


@dataclass
class Model:
    bins: np.ndarray  # sorted, with a weight other than 0
    weights: np.ndarray  # idf included
    thresholds: np.ndarray

    def chances(self, score: np.ndarray) -> np.ndarray:
        """Chance of each grade, one row for each score."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))
        return np.diff(np.concatenate((np.zeros((len(score), 1)), below, np.ones((len(score), 1))), axis=1), axis=1)

    def scores(self, text: pa.Array) -> np.ndarray:
        out = []
        for data, at in B.slices(text):
            bins, first = _bins(data, at)
            first, bins = first * bins.shape[1], bins.ravel()
            spot = np.searchsorted(self.bins, bins)
            hit = np.flatnonzero(self.bins[np.minimum(spot, len(self.bins) - 1)] == bins) if len(self.bins) else np.zeros(0, np.int64)
            row = np.searchsorted(first, hit, "right") - 1
            pair, count = np.unique(row * len(self.bins) + spot[hit], return_counts=True)
            gain = np.log1p(count) * self.weights[pair % max(1, len(self.bins))]
            out.append(np.bincount(pair // max(1, len(self.bins)), gain, len(at) - 1))
        return np.concatenate(out) if out else np.zeros(0)


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 500.0))


@dataclass
class Telling:
    """Sorted feature bins that speak for a kind or carry a weight, and how many toxic and clean documents have them."""

    bins: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    strong: np.ndarray
    weighted: np.ndarray


def telling(bins: np.ndarray, a: np.ndarray, b: np.ndarray, y: int, n: int) -> Telling:
    """Of bins in ``a`` toxic and ``b`` clean documents those that matter, with ``y`` of ``n`` documents toxic."""
    odds = np.log((a + 0.5) / (y + 1)) - np.log((b + 0.5) / (n - y + 1))
    strong = (odds >= 2) & (a >= LEAST)
    # Words whose presence tells the kinds apart beyond chance (chi-square of the two-by-two table); the others would only learn
    # the noise in the labels by heart.
    with_word = a + b
    chi = n * (a * (n - y - b) - b * (y - a)) ** 2 / np.maximum(with_word * (n - with_word) * y * (n - y), 1e-9)
    weighted = (chi >= SIGNIFICANT) & (with_word >= LEAST)
    at = strong | weighted
    return Telling(bins[at], a[at], b[at], strong[at], weighted[at])


def fit_arrays(bins: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray, told: Telling) -> Model:
    """Fits on sparse rows of told bins and their counts, with documents of both kinds."""
    used = told.bins
    row = np.repeat(np.arange(len(bins), dtype=np.int32), [len(b) for b in bins])
    col, value = np.searchsorted(used, np.concatenate(bins)), np.log1p(np.concatenate(counts))
    burden = np.bincount(row, value * told.strong[col], len(bins))
    cuts = np.quantile(burden[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (burden[:, None] > cuts[None, :]).sum(axis=1), 0)

    idf = np.log(len(bins) / (told.toxic + told.clean))
    keep = told.weighted[col]
    row, col, value = row[keep], col[keep], value[keep] * idf[col[keep]]
    w, theta = np.zeros(len(used)), np.array([1.0, 2.0, 3.0])
    moments = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(3), np.zeros(3)]
    for step in range(1, STEPS + 1):
        score = np.bincount(row, value * w[col], len(bins))
        # Each grade lies between two thresholds; the gradient of its log chance by the upper and the lower one.
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        high, low = (1 / (1 + np.exp(np.clip(score - e, -500, 500))) for e in (edge[grade + 1], edge[grade]))
        chance = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / chance, low * (1 - low) / chance
        g_score = (up - down) / len(bins)
        g_theta = (np.bincount(grade, -up, GRADES)[:-1] + np.bincount(grade, down, GRADES)[1:]) / len(bins)
        g_w = np.bincount(col, value * g_score[row], len(used))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for x, g, m, v in ((w, g_w, moments[0], moments[1]), (theta, g_theta, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
            x -= rate * m / (1 - 0.9**step) / scale
            if x is w:
                w[:] = np.sign(w) * np.maximum(np.abs(w) - rate * L1 / scale, 0)
        theta = np.maximum.accumulate(theta + np.array([0, 1e-6, 2e-6]))
    full = np.flatnonzero(w)
    return Model(used[full].astype(np.int64), w[full] * idf[full], theta)


def _narrowed(wanted: np.ndarray):
    """A column function that keeps of a row's features those with a wanted bin."""

    @F.arrow_udf(FEATURES)
    def narrow(f: pa.Array) -> pa.Array:
        kept = []
        for x in f:
            bins, counts = (x[k].values.to_numpy() for k in ("bins", "counts"))
            here = np.isin(bins, wanted)
            kept.append((bins[here], counts[here]))
        return pa.StructArray.from_arrays([B.lists([x[k] for x in kept], pa.int32()) for k in (0, 1)], names=["bins", "counts"])

    return narrow


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled documents whose hashed ids are smallest; an id with several texts counts once, with the text whose hash is smallest.

    Spark counts the documents with each feature; the driver gets those counts, ``BINS`` at most, and of the sample's rows only
    the features that matter.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("k_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("k_id"), "k_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("k_id"))
    once = joined.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = cut(once.select("doc_id", (F.col("y") > 0).alias("toxic"), features("text").alias("f")))
    n, y = found.agg(F.count("*"), F.count_if("toxic")).first()
    if y in (0, n):
        return NOTHING
    seen = found.select("toxic", F.explode("f.bins").alias("bin")).groupBy("bin").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    seen = seen.where(F.col("a") + F.col("b") >= LEAST).toArrow().sort_by("bin")
    told = telling(seen["bin"].to_numpy(), *(seen[c].to_numpy().astype(float) for c in "ab"), y, n)
    rows = found.select("doc_id", "toxic", _narrowed(told.bins)("f").alias("f")).select("doc_id", "toxic", "f.bins", "f.counts").toArrow().sort_by("doc_id")
    bins, counts = ([x.values.to_numpy() for x in rows[c].combine_chunks()] for c in ("bins", "counts"))
    return fit_arrays(bins, counts, np.array(rows["toxic"].to_pylist(), bool), told)


SCORED = T.StructType([*(T.StructField(f"p{k}", T.DoubleType()) for k in range(GRADES)), T.StructField("severity", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def scorer(model: Model):
    """A column function from a text to the chances of its grades, its severity and whether it is rejected."""

    @F.arrow_udf(SCORED)
    def score(text: pa.Array) -> pa.Array:
        scores = model.scores(text)
        chance = model.chances(scores)
        severity = chance @ np.arange(GRADES)
        return pa.StructArray.from_arrays([*(pa.array(chance[:, k]) for k in range(GRADES)), pa.array(severity), pa.array((chance[:, 0] < 0.5) & (scores > 0))], names=SCORED.names)

    return score


def severities(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's id, chances of the grades, expected grade and verdict."""
    score = scorer(fit(docs, labels))
    return docs.select(F.col(row_id), score(F.col(text)).alias("s")).select(row_id, "s.*")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.where(~scorer(fit(docs, labels))(docs["text"])["rejected"])
