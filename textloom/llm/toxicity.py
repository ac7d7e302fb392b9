"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, pairs of adjacent words and pairs with one word between them, each once per
text, hashed to 2**20 places. FTRL-proximal keeps a learning rate per coordinate, and its L1 term
leaves weights at exactly zero until enough examples speak for them; the few that are not zero go to
the executors. Their number is bounded by the number of places, whatever the corpus is.

Weights fit the texts that they were learnt from better than others. So a second model, which leaves out
each fourth text, scores those it left out, and a slope and an offset by which its scores agree with their labels
go into the weights: a score is then a probability for unseen texts, and a threshold means what it says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.llm.links import free_names
from textloom.plans.scratch import settle
from textloom.llm.words import ALNUM, U64, bytes_of, mix, word_hashes
from textloom.llm.workers import handing_back

PLACES_BITS = 20
#: Bound on the labelled rows of each class that training reads, whatever the table's size.
SAMPLE_PER_CLASS = 6000
THRESHOLD = 0.7
#: One example of so many is spared to calibrate scores.
SPARED = 4
CHUNK_WORDS = 1 << 19


@dataclass(frozen=True)
class Rates:
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 6


@dataclass(frozen=True)
class Weights:
    """The places with weights other than zero, in order, and the intercept."""

    places: np.ndarray
    values: np.ndarray
    bias: float


def _grams(words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, rows`` of words, pairs and pairs with a gap; not yet once per text."""
    down = U64(64 - PLACES_BITS)
    yield (words >> down).astype(np.int64), row
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix(words[:-gap] * U64(3) + words[gap:] * U64(salt))[same]
            yield (pair >> down).astype(np.int64), row[:-gap][same]


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, rows`` for chunks of a text column of bounded size; pairs across chunks are seen once."""
    data, at = bytes_of(column, lower=True)
    words, counts = word_hashes(data, at, ALNUM)
    row = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(words), CHUNK_WORDS):
        yield from _grams(words[lo : lo + CHUNK_WORDS + 2], row[lo : lo + CHUNK_WORDS + 2])


class Ftrl:
    def __init__(self, rates: Rates):
        self.rates = rates
        self.z = np.zeros((1 << PLACES_BITS) + 1)
        self.n = np.zeros((1 << PLACES_BITS) + 1)  # the last place is the intercept

    def weights(self, at: np.ndarray) -> np.ndarray:
        r, z = self.rates, self.z[at]
        l1 = np.where(at == 1 << PLACES_BITS, 0.0, r.l1)
        w = (np.sign(z) * l1 - z) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << PLACES_BITS)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.rates.alpha * w
        self.n[at] = grown


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label, h, places`` for rows of ``text, label, h``: the distinct places of each text's features."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            got: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
            for places, rows in features(part.column(0)):
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
                for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    got[i].append(places[order[x:y]])
            lists = [np.unique(np.concatenate(x)).astype(np.int32) if x else np.zeros(0, np.int32) for x in got]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(lists, pa.list_(pa.int32()))], ["label", "h", "places"])


def _fit(batches: Iterator[pa.RecordBatch], rates: Rates, shift: float) -> Iterator[pa.RecordBatch]:
    examples: list[tuple[int, np.ndarray]] = []
    for batch in batches:
        lists = batch.column(1)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        examples += [(label, flat[x:y]) for label, x, y in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True)]
    w = fitted(examples, rates).weights(np.arange((1 << PLACES_BITS) + 1))
    w[-1] += shift
    slope, offset = calibration(examples, rates, shift)
    w *= slope
    w[-1] += offset
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["place", "weight"])


def fitted(examples: list[tuple[int, np.ndarray]], rates: Rates) -> Ftrl:
    """A model that has seen the examples ``(label, places)`` once an epoch, in a fixed random order."""
    model, order = Ftrl(rates), np.random.default_rng(7)
    for _ in range(rates.epochs):
        for i in order.permutation(len(examples)):
            model.learn(examples[i][1].astype(np.int64), examples[i][0])
    return model


def calibration(examples: list[tuple[int, np.ndarray]], rates: Rates, shift: float) -> tuple[float, float]:
    """``slope, offset`` by which log-odds of texts that a model has not seen agree best with their labels.

    ``shift`` is what the log-odds of the classes in the table exceed those in the sample by; it also weighs the labels.
    Few examples move the slope little from 1 and the offset little from 0.
    """
    spared = examples[::SPARED]
    model = fitted([x for i, x in enumerate(examples) if i % SPARED], rates)
    label = np.array([x[0] for x in spared], float)
    if not 0 < label.sum() < len(label):
        return 1.0, 0.0
    odds = np.array([model.weights(np.append(x[1], 1 << PLACES_BITS)).sum() for x in spared]) + shift
    share = np.where(label == 1, math.exp(shift), 1.0)
    share *= len(share) / share.sum()
    x, start = np.stack([odds, np.ones(len(odds))], axis=1), np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        value = x @ at
        return float((share * (np.logaddexp(0, value) - label * value)).sum() + ((at - start) ** 2).sum() / 2)

    at = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (share * (p - label)) + at - start
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
        while np.abs(step).max() > 1e-12 and loss(at - step) > loss(at):
            step = step / 2
        at = at - step
        if np.abs(step).max() <= 1e-12:
            break
    return float(at[0]), float(at[1])


def held_out(doc_id: Column) -> Column:
    """True for the rows that training never sees: crc32 of the id as text has remainder 1 by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), per_class: int = SAMPLE_PER_CLASS) -> Weights:
    """Fit on at most ``per_class`` labelled texts of each class, those with the smallest hashes of ids.

    Held-out rows and rows without a label or an id are left out; of several labels of an id the
    largest counts. The intercept is shifted from the sample's class shares to those of all labels,
    and scores are calibrated on examples spared for it.
    Without labels of both classes every score is the share of the class that there is, or a half.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    known = settle(known, "toxic-labels")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).filter("label in (0, 1)").collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    if not n0 or not n1:
        share = 0.5 if n0 == n1 else (0.999 if n1 else 0.001)
        return Weights(np.zeros(0, np.int64), np.zeros(0), math.log(share / (1 - share)))
    by_hash = F.xxhash64(F.col("doc_id"))
    parts = [known.filter(F.col("label") == k).orderBy(by_hash, "doc_id").limit(per_class) for k in (0, 1)]
    picked = settle(parts[0].unionByName(parts[1]), "toxic-sample")
    # at most 2 * per_class ids of a few bytes each
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # several rows of one id are several examples, up to the same bound
    sample = sample.select("text", "label", F.xxhash64("doc_id", "text").alias("h"))
    # features are hashed where the texts are; the one task that fits gets their places
    sample = sample.mapInArrow(handing_back(_places), "label int, h long, places array<int>").orderBy("h", "label", "places").limit(2 * per_class)
    sample = sample.select("label", "places").coalesce(1)
    shift = math.log(n1 / n0) - math.log(min(n1, per_class) / min(n0, per_class))
    rows = settle(sample.mapInArrow(handing_back(lambda x: _fit(x, rates, shift)), "place long, weight double"), "toxic-weights").collect()
    bias = sum(r["weight"] for r in rows if r["place"] == 1 << PLACES_BITS)
    rows = sorted((r["place"], r["weight"]) for r in rows if r["place"] < 1 << PLACES_BITS)
    return Weights(np.array([p for p, _ in rows], np.int64), np.array([w for _, w in rows], float), bias)


def with_scores(df: DataFrame, weights: Weights, text: str = "text", score: str = "score") -> DataFrame:
    """The rows of ``df`` with a column ``score`` from 0 to 1 for each whole text; higher is likelier toxic.

    A null text is an empty text, whose score is the intercept's alone. Where there is such a column already, the new one,
    which is the last, has underscores at its name's end. Rows stay in their partitions.
    """
    score = free_names(df.columns, score)[0]
    small, at = df.sparkSession.sparkContext.broadcast(weights), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = small.value
        table = np.zeros(1 << PLACES_BITS)
        table[w.places] = w.values
        telling = table != 0
        for batch in batches:
            total = np.full(batch.num_rows, w.bias)
            for lo in range(0, batch.num_rows, 256):
                hits = [
                    np.unique(rows[keep].astype(np.int64) << PLACES_BITS | places[keep])
                    for places, rows in features(batch.column(at).slice(lo, 256))
                    for keep in [telling[places]]
                ]
                if hits:
                    seen = np.unique(np.concatenate(hits))
                    np.add.at(total, lo + (seen >> PLACES_BITS), table[seen & ((1 << PLACES_BITS) - 1)])
            scores = pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, score])

    return df.mapInArrow(handing_back(run), StructType([*df.schema.fields, StructField(score, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Every whole text is scored, null texts as empty ones, repeated rows each; an empty table gives an
    empty result; other columns are ignored. Only the text goes into a score.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = with_scores(rows, train(docs, labels, rates)).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns as they are.

    Null and empty texts have a score like others; a score at the threshold is toxic. Repeated rows stay or go together. Empty ``docs``
    give an empty result; without usable ``labels`` all texts score alike. Other columns are kept, whatever their names.
    """
    name = free_names(docs.columns, "toxicity")[0]
    return with_scores(docs, train(docs, labels, rates), score=name).filter(F.col(name) < threshold).drop(name)
