"""Language identification in two steps: the family by one-versus-rest linear classifiers, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted
from .textnum import letter_table, mix, codes, pieces

DIMS = 4096
#: Documents in the training sample, for each language, about.
SAMPLE = 600
#: Languages that a model tells apart at most, those with most rows.
LANGUAGES = 200
#: Families of closely related languages, fixed values; a language in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "mr", "ne", "bn"),
}


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row a text: the root of each hashed n-gram's share (1 to 3 letters, words padded by one blank), and the letters of each text."""
    cp, starts = codes(texts)
    low = letter_table()[cp].astype(np.uint64)
    letter = low != 0
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # one blank before each word, one after
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    doc = np.searchsorted(starts, at, side="right") - 1
    x = low[at] + np.uint64(32) * (low[at] == 0)
    n = len(texts)
    counts = np.zeros(n * DIMS, np.float32)
    part = mix(x * np.uint64(0x100000001B3))
    for width in (1, 2, 3):
        if width > 1:
            part = mix(part[:-1] * np.uint64(31) + x[width - 1 :] + np.uint64(width))
        same = doc[width - 1 :] == doc[: len(part)]
        counts += np.bincount(doc[: len(part)][same] * DIMS + (part[same] % np.uint64(DIMS)).astype(np.int64), minlength=n * DIMS)
    counts = counts.reshape(n, DIMS)
    np.sqrt(counts, out=counts)
    counts /= np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)
    return counts, np.bincount(np.searchsorted(starts, np.flatnonzero(letter), side="right") - 1, minlength=n)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, the last weight is the bias) by accelerated gradients; y is 1 or -1, classes weigh alike."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v, t, rate = w.copy(), 1.0, 1.0 / (1.0 + 4.0 * c)
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * c * (x.T @ (share * y * gap)))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return w


class Model:
    """families: names in order; family_w: a row each; within: (family, a, b) -> weights, positive for a."""

    def __init__(self, x: np.ndarray, labels: list[str]) -> None:
        y = np.array(labels, dtype=object)
        self.languages = sorted(set(labels))
        self.of = {lang: family(lang) for lang in self.languages}
        self.families = sorted(set(self.of.values()))
        kin = np.array([self.of[v] for v in labels], dtype=object)
        self.family_w = np.stack([fit_svm(x, np.where(kin == f, 1, -1).astype(np.float32)) for f in self.families]) if len(self.families) > 1 else np.zeros((len(self.families), DIMS + 1), np.float32)
        self.within = {}
        for a, b in combinations(self.languages, 2):
            if self.of[a] == self.of[b]:
                some = (y == a) | (y == b)
                self.within[a, b] = fit_svm(x[some], np.where(y[some] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row, and the softmax of the family's margin times that of its votes."""
        x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
        soft = lambda z: (e := np.exp(3 * (z - z.max(1, keepdims=True)))) / e.sum(1, keepdims=True)
        first = soft(x @ self.family_w.T)
        best = first.argmax(1)
        lang, score = np.empty(len(x), object), first.max(1).astype(np.float64)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            mine = [v for v in self.languages if self.of[v] == f]
            votes, margin = np.zeros((len(rows), len(mine))), np.zeros((len(rows), len(mine)))
            for i, j in combinations(range(len(mine)), 2):
                m = x[rows] @ self.within[mine[i], mine[j]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                margin[:, i] += m
                margin[:, j] -= m
            lang[rows] = np.array(mine, object)[(votes + 1e-3 * np.tanh(margin)).argmax(1)] if len(rows) else []
            if len(mine) > 1 and len(rows):
                score[rows] *= soft(margin / (len(mine) - 1)).max(1)
        return lang.tolist(), np.clip(score, 0, 1)


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model | None:
    """A model of docs (doc_id, text, lang); None if no row has both a language and letters.

    The sample takes each row by a hash of its id and text with the probability that gives about ``sample`` rows a
    language, for the LANGUAGES that have most rows, so its size is bounded at any input size. Rows alike count once,
    and what is beyond twice the sample goes in order of a hash: the same rows always. Texts are turned into vectors
    of DIMS on the executors.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not n:
        return None
    share = F.lit(0.0)
    for lang, count in n.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / count))).otherwise(share)
    taken = known.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, most=400_000, rows=150):
            x, letters = features(texts)
            rows = np.flatnonzero(letters)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows)), pa.array([r.astype(np.float16).tobytes() for r in x[rows]], pa.binary())], ["lang", "x"])

    rows = taken.mapInArrow(vectors, "lang string, x binary").distinct().orderBy(F.xxhash64("x"), "lang").limit(2 * sample * len(n)).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the same model whatever the order of arrival
    return Model(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(doc_id, keep..., lang_pred, score) for each row of docs: ``und`` with score 0 for a null text, one without letters, or no model.

    A map: repeated rows stay, ties between languages go by alphabet, long texts are read whole, an empty table gives
    an empty result. names are those of the two new columns; columns in keep with the same names raise ValueError.
    """
    if {c.lower() for c in names} & {c.lower() for c in (*keep, "doc_id")}:
        raise ValueError(f"columns {names} are there already; give other names")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in dict.fromkeys(("doc_id", *keep)) if c != "text"]
    whole = "text" in keep
    fields = [f for f in docs.schema.fields if f.name in kept]
    mine = [f"c{k}" for k in range(len(fields))] + ["text"] * whole  # Spark's Arrow maps take plain names only
    schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)] + ["text string"] * whole + ["lang_pred string", "score double"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in pieces(batches, most=400_000, rows=150):
            x, letters = features(texts)
            lang, score = m.predict(x) if m else (["und"] * len(texts), np.zeros(len(texts)))
            lang = [v if n else "und" for v, n in zip(lang, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in mine), pa.array(lang, pa.string()), pa.array(np.where(letters > 0, score, 0.0))], [*mine, "lang_pred", "score"])

    plain = docs.select(*[F.col(quoted(f.name)).alias(f"c{k}") for k, f in enumerate(fields)], "text")
    return plain.mapInArrow(rows, schema).toDF(*(f.name for f in fields), *["text"] * whole, *names)


def by_language(column: Column) -> Column:
    """Whether a prediction names a language."""
    return column != "und"
