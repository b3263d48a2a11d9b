"""Toxicity by two class-conditional Kneser-Ney word models that share their backoff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .textnum import pieces, words

#: Labelled documents of each class in the training sample, about; of these a fourth sets the scale of the scores.
SAMPLE = 1600
START = np.uint64(0x5851F42D4C957F2D)


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its predecessor's hash (START for a text's first), its own, and its text."""
    h, doc = words(texts)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = doc[1:] != doc[:-1]
        before[first] = START
    return before, h, doc


class Model:
    """Log-likelihood ratios of words, and a logistic scale for them.

    A class's probability of a word is its Kneser-Ney share: the distinct words before it, less a discount that the
    counts of counts set, and what the discounts free times a backoff that both classes share: from the number of
    documents n in the whole corpus that hold a word, its expected count of tables in a Pitman-Yor process, n to the power
    of the discount. (Kneser-Ney takes 1 for any n, plain counts take n: both did worse.) A word that no sampled
    document holds has the same ratio whatever its backoff, which cancels, so the model keeps only the sample's words.
    The share of word pairs isn't added: with it held-out AUC fell from 1.00 to 0.96.
    """

    #: Up to this a word's ratio counts as common; what is beyond marks the toxic class.
    COMMON = 2.0

    def __init__(self, vocabulary: np.ndarray, follows: np.ndarray, tables: np.ndarray, total: float) -> None:
        """Sorted hashes of words; for each the distinct words before it, a row for the ordinary and the toxic class; its backoff count; the sum of these for all words of the corpus."""
        self.vocabulary = vocabulary
        follows = np.concatenate((follows, np.zeros((2, 1))), 1)
        shared = np.maximum(np.append(tables, total - tables.sum()), 0.5)
        shared = shared / shared.sum()
        share = []
        for f in follows:
            n = [(f == k).sum() + 1.0 for k in range(5)]
            y = n[1] / (n[1] + 2 * n[2])
            cut = np.clip([0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))], 0, [0, 0.98, 1.9, 2.8])[np.minimum(f, 3).astype(int)]
            share.append((f - cut + cut.sum() * shared) / max(1.0, f.sum()) if f.any() else shared)
        self.ratio = (np.log(share[1]) - np.log(share[0])).astype(np.float32)
        self.middle, self.spread, self.scale, self.prior = np.zeros(4), np.ones(4), np.array([1.0, 5.0, 2.0, 0.0, 0.0]), 0.0

    def inputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean ratio a word of what is common and of what is beyond, the log of the latter's sum and of the words; and the words."""
        word, doc = words(texts)
        n = np.bincount(doc, minlength=len(texts))
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        r = np.where(self.vocabulary[at] == word, self.ratio[at], self.ratio[-1]).astype(np.float64)
        common, beyond = (np.bincount(doc, v, len(texts)) for v in (np.clip(r, -self.COMMON, self.COMMON), np.maximum(r - self.COMMON, 0)))
        size = np.maximum(n, 1)
        return np.stack((common / size, beyond / size, np.log1p(beyond), np.log1p(n)), 1), n

    def fit_scale(self, x: np.ndarray, y: np.ndarray, prior: float) -> None:
        """Logistic regression with classes of equal weight, moved to the prior log odds."""
        self.middle, self.spread, self.prior = x.mean(0), x.std(0) + 1e-9, prior
        x, scale = np.concatenate(((x - self.middle) / self.spread, np.ones((len(x), 1))), 1), np.zeros(5)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
            slope = x.T @ (weight * (y - p)) - 1e-4 * scale
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(5)
            scale = scale + np.clip(np.linalg.solve(bend, slope), -5, 5)
        self.scale = scale

    def scores(self, texts: list[str]) -> np.ndarray:
        x, n = self.inputs(texts)
        z = np.where(n > 0, (x - self.middle) / self.spread @ self.scale[:4] + self.scale[4], 0.0) + self.prior
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_counts(docs: DataFrame) -> DataFrame:
    """(word, docs): each word's hash and in how many rows of docs it occurs, over all whole texts; counts are added up before they are dealt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            word, doc = words(texts)
            order = np.lexsort((doc, word))
            w, d = word[order], doc[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
            kinds, n = np.unique(w[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "docs"])

    return docs.select("text").mapInArrow(count, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Model | float:
    """A model of docs (doc_id, text) and labels (doc_id, toxic); the toxic share (0 without labels) where a class is missing.

    The sample takes labelled ids by a hash with the probability that gives about ``sample`` of each class, so all that
    the driver and the executors hold of it is bounded at any input size; that is also why its ids may be broadcast.
    An id with several labels is toxic if one of them says so. The shared backoff counts all rows of docs.
    """
    by_id = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in by_id.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return float(1 in n)
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    taken = by_id.filter(u < F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / n[1]))).otherwise(F.lit(min(1.0, sample / n[0]))))
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    few = docs.select("doc_id", "text").join(F.broadcast(taken.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(4 * sample).withColumn("scale", part)), "doc_id")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            before, word, doc = _pairs(texts)
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)[doc]
            order = np.lexsort((word, before, toxic))
            t, b, w = toxic[order], before[order], word[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (w[1:] != w[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(t[at] == 1), pa.array(b[at].view(np.int64)), pa.array(w[at].view(np.int64))], ["toxic", "before", "word"])

    kinds = few.filter("not scale").mapInArrow(pairs, "toxic boolean, before long, word long").distinct()
    kinds = kinds.groupBy("word").agg(F.count_if(~F.col("toxic")).alias("n0"), F.count_if("toxic").alias("n1"))
    corpus = stage(document_counts(docs), "words")
    once, twice = corpus.agg(F.count_if(F.col("docs") == 1), F.count_if(F.col("docs") == 2)).first()
    tables = F.floor(F.col("docs") ** (once / max(once + 2 * twice, 1)) * 1024)  # whole numbers: sums don't depend on their order
    total = (corpus.agg(F.sum(tables)).first()[0] or 0) / 1024
    kinds = kinds.join(corpus.select("word", (tables / 1024).alias("tables")), "word").toArrow()
    prior = n[1] / (n[0] + n[1])
    if not kinds.num_rows:
        return prior
    word = kinds.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    model = Model(word[order], np.stack([kinds.column(c).to_numpy()[order].astype(np.float64) for c in ("n0", "n1")]), kinds.column("tables").to_numpy()[order], total)
    model.prior = float(np.log(n[1] / n[0]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            x, size = shared.value.inputs(texts)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"]).filter(pa.array(size > 0))

    rows = few.filter("scale").mapInArrow(rate, "toxic int, x array<double>").orderBy(F.xxhash64("x"), "toxic").limit(8 * sample).collect()
    rows.sort(key=lambda r: (r["toxic"], r["x"]))
    if len({r["toxic"] for r in rows}) == 2:
        model.fit_scale(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], np.float64), model.prior)
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text): a map. Null and empty texts get the labels' prior.

    Repeated rows stay and get the same score, long texts are read whole, an empty table gives an empty result, and
    other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(texts), m) if isinstance(m, float) else m.scores(texts))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double")
