"""Subject areas of documents: averaged word and subword embeddings with logistic outputs.

The model is linear over averaged embeddings: a sentence is the mean of the
vectors of its words and of their letter five-grams, and every area has its own
logistic output.  It is trained on sentences that inherit the areas of their
document; a sentence that says nothing about an area occurs with all areas alike
and stays below the threshold, so documents need no sentence labels.

*Training* uses at most ``max_labelled`` labelled documents (those whose ids have
the least hashes), the one documented bound.  The sample is spread over ``shards``
tasks and cut into ``slices``.  In each step every task works out the gradient of
its part of one slice at the parameters it is sent; the gradients are summed, and
one Adam step follows, so gradients are synchronised in every step.  A fifth of
the sample is held out and chooses the threshold.

*Scoring* reads every document, whole.  As the model is linear, a word's share of
all outputs is computed once per worker and looked up from then on.  An area
counts for a document if at least ``min_sentences`` of its sentences are about
it, or if it has at most two sentences and all are.

Defined results: a null, empty or wordless text has no area; a document without
labels is scored like any other; labels of unknown areas, or without a document,
are ignored; without any labels there is no model and no result; repeated rows
give one result; texts of any length and language are scored; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import Staged

#: A word, or the end of a sentence or paragraph.
_TOKENS = re.compile(r"[^\W\d_]+|(?<!\brs)(?<!\bno)(?<!\bdr)(?<!\bmr)[.!?]+(?=[\"'”’)\]]*(?:\s|$))|\n[ \t]*\n")
_ENDS = ".!?\n"
GRAM = 5
MAX_CACHE = 400_000


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 6000
    shards: int = 4
    slices: int = 5
    steps: int = 50
    dim: int = 16
    rate: float = 0.05
    min_count: int = 3
    min_sentences: int = 3
    held_out: float = 0.2


def features_of(word: str) -> list[str]:
    """The word itself and its letter five-grams, its ends marked."""
    if len(word) < GRAM:
        return [word]
    marked = f"<{word}>"
    return [word, *("#" + marked[k : k + GRAM] for k in range(len(marked) - GRAM + 1))]


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of every sentence that has any."""
    out: list[list[str]] = [[]]
    if text:
        for token in _TOKENS.findall(text.lower()):
            if token[0] not in _ENDS:
                out[-1].append(token)
            elif out[-1]:
                out.append([])
    return [s for s in out if s]


@dataclass
class Model:
    areas: list[str]
    vocabulary: dict[str, int]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    threshold: float = 0.5

    def outputs(self) -> np.ndarray:
        """The share of each feature in the outputs: embeddings times weights."""
        return self.embeddings @ self.weights


class Scorer:
    """Sentence outputs with a table of words seen so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.shares = model, model.outputs()
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = 0
        self.table = np.zeros((1024, len(self.model.areas) + 1), np.float32)

    def _add(self, word: str) -> int:
        """The row of a new word; all ends of sentences share row 0."""
        if word[0] in _ENDS:
            self.index[word] = 0
            return 0
        self.rows += 1
        at = self.index[word] = self.rows
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        known = [k for f in features_of(word) if (k := self.model.vocabulary.get(f)) is not None]
        if known:
            self.table[at, :-1] = self.shares[known].sum(axis=0)
            self.table[at, -1] = len(known)
        return at

    def decide(self, texts: list[str | None], min_sentences: int) -> np.ndarray:
        """A mark per text and area."""
        return self.marks(*self.sentences(texts), min_sentences, self.model.threshold)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of all sentences, and how many each text has."""
        if len(self.index) > MAX_CACHE:
            self.clear()
        ids: list[int] = []
        ends: list[int] = []
        index, add = self.index, self._add
        for text in texts:
            if text:
                ids += [index[t] if t in index else add(t) for t in _TOKENS.findall(text.lower())]
            ids.append(0)
            ends.append(len(ids))
        rows = np.array(ids, np.int64)
        word = rows > 0
        places = np.flatnonzero(word)
        # a sentence starts at the first word after an end
        starts = np.flatnonzero(np.diff(np.cumsum(~word)[places], prepend=-1))
        counts = np.diff(np.searchsorted(places[starts], [0, *ends])) if len(starts) else np.zeros(len(texts), int)
        if not len(starts):
            return np.zeros((0, len(self.model.areas)), np.float32), counts
        sums = np.add.reduceat(self.table[rows[places]], starts, axis=0)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.model.bias, counts

    @staticmethod
    def marks(z: np.ndarray, n: np.ndarray, min_sentences: int, limit: float) -> np.ndarray:
        about = z > np.log(limit / (1 - limit))
        ends = np.concatenate([[0], np.cumsum(n)])
        total = np.concatenate([np.zeros((1, about.shape[1]), np.int64), np.cumsum(about, axis=0)])
        per_text = total[ends[1:]] - total[ends[:-1]]
        short = ((n > 0) & (n <= 2))[:, None] & (per_text == n[:, None])
        return (per_text >= min_sentences) | short


def _gradient(index: np.ndarray, sizes: np.ndarray, labels: np.ndarray, params: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(features used, their gradients, gradient of weights, of bias), summed over sentences of ``sizes`` features."""
    embeddings, weights, bias = params
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    used, place = np.unique(index, return_inverse=True)
    hidden = np.add.reduceat(embeddings[index], begin, axis=0) / sizes[:, None]
    error = 1 / (1 + np.exp(-(hidden @ weights + bias))) - labels
    back = np.repeat((error @ weights.T) / sizes[:, None], sizes, axis=0)
    grad = np.stack([np.bincount(place, back[:, k], minlength=len(used)) for k in range(embeddings.shape[1])], axis=1)
    return used, grad, hidden.T @ error, error.sum(axis=0)


def _flat(arrays: tuple[np.ndarray, ...]) -> bytes:
    return b"".join(a.astype(np.float32).tobytes() for a in arrays)


class Adam:
    """Parameters and their moments; a step follows each summed gradient."""

    def __init__(self, params: tuple[np.ndarray, ...], rate: float) -> None:
        self.params, self.rate, self.step = params, rate, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def follow(self, grads: tuple[np.ndarray, ...]) -> None:
        self.step += 1
        for p, (m, v), g in zip(self.params, self.moments, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def labelled_sample(documents: DataFrame, labels: DataFrame, areas: list[str], s: Settings) -> DataFrame:
    """(doc_id, text, marks array<float>, held_out) of at most ``max_labelled`` labelled documents."""
    marks = [F.max(F.when(F.col("area") == a, 1.0).otherwise(0.0)).cast("float") for a in areas]
    known = (
        labels.where(F.col("area").isin(areas) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.array(*marks).alias("marks"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.max_labelled)
    )
    split = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(1000)) < int(1000 * s.held_out)
    # at most max_labelled rows of a few numbers each
    return documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("held_out", split)


def train(documents: DataFrame, labels: DataFrame, areas: list[str], s: Settings = Settings()) -> Model | None:
    """Fit the model; None without labelled documents."""
    spark = documents.sparkSession
    sample = Staged(labelled_sample(documents, labels, areas, s), "area-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = Counter(w for x in sentences_of(text) for w in x)
                for w, n in words.items():
                    for f in features_of(w):
                        seen[f] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    fit = sample.df.where(~F.col("held_out"))
    counted = fit.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    # bounded by the words of the sample
    vocabulary = {f: i for i, f in enumerate(sorted(r.feature for r in counted.where(F.col("n") >= s.min_count).toLocalIterator()))}
    if not vocabulary:
        return None
    shared = spark.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, marks, slices = [], [], []
            for text, m, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for words in sentences_of(text):
                    row = [k for w in words for f in features_of(w) if (k := known.get(f)) is not None]
                    if row:
                        rows.append(row)
                        marks.append(m)
                        slices.append(part)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.float32())), pa.array(slices, pa.int32())], names=["row", "marks", "slice"])

    part = lambda of, n: F.pmod(F.xxhash64(F.lit(of), "doc_id"), F.lit(n)).cast("int")
    by_shard = fit.repartition(s.shards, part("shard", s.shards)).select("text", "marks", part("slice", s.slices).alias("slice"))
    sentences = Staged(by_shard.mapInArrow(index, "row array<int>, marks array<float>, slice int"), "area-sentences", partition="slice")

    def gradients(params: tuple[np.ndarray, ...], number: int) -> tuple[np.ndarray, ...] | None:
        """The mean gradient over one slice: those of all tasks summed, in the order of their arrival."""
        sent = spark.sparkContext.broadcast(params)

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, sizes, labels_ = [], [], []
            for batch in batches:
                index.append(batch.column(0).flatten().to_numpy())
                sizes.append(np.diff(batch.column(0).offsets.to_numpy()))
                labels_.append(batch.column(1).flatten().to_numpy().reshape(len(batch), -1))
            if sum(map(len, sizes)):
                used, *grads = _gradient(np.concatenate(index), np.concatenate(sizes), np.concatenate(labels_), sent.value)
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, sizes))], pa.int64()), pa.array([used.astype(np.int32).tobytes()]), pa.array([_flat(grads)])], names=["n", "used", "grads"])

        # one slice, by its folder; files may be read together, but never more tasks than shards take part
        part = sentences.df.where(F.col("slice") == number % s.slices).select("row", "marks")
        total, n = [np.zeros_like(p) for p in params], 0
        # one row per shard
        for r in part.coalesce(s.shards).mapInArrow(of_task, "n long, used binary, grads binary").toLocalIterator():
            used, flat, at = np.frombuffer(r.used, np.int32), np.frombuffer(r.grads, np.float32), len(r.used) // 4 * s.dim
            total[0][used] += flat[:at].reshape(-1, s.dim)
            for t in total[1:]:
                t += flat[at : at + t.size].reshape(t.shape)
                at += t.size
            n += r.n
        sent.unpersist()
        return tuple(t / n for t in total) if n else None

    rng = np.random.default_rng(0)
    adam = Adam(
        (
            rng.normal(0, 0.1, (len(vocabulary), s.dim)).astype(np.float32),
            rng.normal(0, 0.1, (s.dim, len(areas))).astype(np.float32),
            np.full(len(areas), -2.0, np.float32),
        ),
        s.rate,
    )
    for number in range(s.steps):
        grads = gradients(adam.params, number)
        if grads is not None:
            adam.follow(grads)
    if not adam.step:
        return None
    params = adam.params
    model = Model(areas, vocabulary, *params)
    model.threshold = _best_threshold(sample.df.where("held_out"), model, s)
    sample.drop()
    sentences.drop()
    return model


def _best_threshold(held_out: DataFrame, model: Model, s: Settings) -> float:
    """The threshold with the best F1 over held-out documents; the middle of the best ones at ties."""
    grid = [k / 20 for k in range(8, 19)]
    shared = held_out.sparkSession.sparkContext.broadcast(model)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, out = Scorer(shared.value), np.zeros((len(grid), 3), np.int64)
        for batch in batches:
            truth = np.array(batch.column(1).to_pylist(), bool).reshape(len(batch), -1)
            z, n = scorer.sentences(batch.column(0).to_pylist())
            for k, t in enumerate(grid):
                marks = scorer.marks(z, n, s.min_sentences, t)
                out[k] += ((marks & truth).sum(), (marks & ~truth).sum(), (~marks & truth).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid))), *(pa.array(out[:, i]) for i in range(3))], names=["k", "tp", "fp", "fn"])

    rows = held_out.select("text", "marks").mapInArrow(test, "k long, tp long, fp long, fn long").groupBy("k").agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).collect()
    f1 = {r[0]: 2 * r[1] / max(1, 2 * r[1] + r[2] + r[3]) for r in rows}
    if not f1 or max(f1.values()) == 0:
        return 0.6
    best = [k for k, v in sorted(f1.items()) if v >= max(f1.values()) - 0.002]
    return grid[best[len(best) // 2]]


def score(documents: DataFrame, model: Model | None, s: Settings = Settings()) -> DataFrame:
    """(doc_id, area) of every document."""
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], "doc_id long, area string")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        areas = np.array(scorer.model.areas, object)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for at in range(0, len(batch), 256):
                doc, area = np.nonzero(scorer.decide(texts[at : at + 256].to_pylist(), s.min_sentences))
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + doc], pa.int64()), pa.array(areas[area], pa.string())], names=["doc_id", "area"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    return rows.mapInArrow(run, "doc_id long, area string").distinct()


def document_areas(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Train on the labelled documents and score all."""
    # the areas are a short fixed list
    areas = sorted({r.area for r in subject_areas.select("area").toLocalIterator() if r.area is not None})
    return score(documents, train(documents, labels, areas, s) if areas else None, s)
