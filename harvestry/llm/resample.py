"""Importance resampling towards a target's words: hashed n-gram gains, seeded Gumbel noise, and an exact draw by radix selection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .textnum import pieces

#: Hashed features are counted in so many buckets: counts and gains are arrays of this length, whatever the corpus.
BUCKETS = 10_000
#: Bits of a digit: a histogram of a selection round has at most 2**DIGIT rows.
DIGIT = 16
#: Longer words are hashed one by one.
LONG = 64


def _word_bytes() -> np.ndarray:
    """Which bytes of a lower-cased UTF-8 text belong to words: digits, a to z, and all beyond ASCII."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_WORD, _CRC = _word_bytes(), _crc_table()


def crc_runs(raw: bytes, begin: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run raw[begin:end], continued from the crc32 before it (0: none); many runs at a time, a byte of each in a step."""
    b, size = np.frombuffer(raw, np.uint8), end - begin
    out = before.astype(np.uint32)
    for k in np.flatnonzero(size > LONG):
        out[k] = zlib.crc32(raw[begin[k] : end[k]], int(out[k]))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    at, state = begin[order], out[order] ^ np.uint32(0xFFFFFFFF)
    left = np.searchsorted(-size[order], -np.arange(1, LONG + 1), side="right")  # runs of at least so many bytes stand first
    for k, n in enumerate(left):
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ b[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each feature: all words, and all pairs of neighbouring words joined by one space."""
    raw = b"\n".join(t.encode() for t in texts).lower() + b"\n"
    inside = np.concatenate(([False], _WORD[np.frombuffer(raw, np.uint8)]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[0::2], edge[1::2]
    starts = np.cumsum([0, *(len(t.encode()) + 1 for t in texts[:-1])])
    doc = np.searchsorted(starts, begin, side="right") - 1
    one = crc_runs(raw, begin, end, np.zeros(len(begin), np.uint32))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    state = one[pair] ^ np.uint32(0xFFFFFFFF)
    spaced = _CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    two = crc_runs(raw, begin[pair + 1], end[pair + 1], spaced)
    return np.concatenate((one, two)) % np.uint32(buckets), np.concatenate((doc, doc[pair]))


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts (text): a task adds up its own, the driver receives at most one row a bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, found in pieces(batches):
            total += np.bincount(features(found, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed share in the target and in the corpus."""
    n = len(corpus)
    return np.floor(1000 * np.log((target + 1.0) * (corpus.sum() + n) / ((corpus + 1.0) * (target.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of a text's gains, 0 where it has no feature."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            bucket, doc = features(texts, len(gain))
            n = np.bincount(doc, minlength=len(texts))
            total = np.bincount(doc, gain[bucket], len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((n + 1) // 2), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) that the seed and the id alone decide; a null id counts as empty text."""
    digits = F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "utf-8"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def kth_key(rows: DataFrame, parts: list[Column], k: int) -> list[int]:
    """The k-th smallest key of rows, exactly; a key is several longs, the first the most significant.

    Radix selection from the highest digit down: a round counts the rows of each digit among those that share the
    digits found so far, and the digit in which the k-th lies is one more. Digits in which none of them differ are
    passed over. A round shuffles one row a task and digit, and the driver receives at most 2**DIGIT.
    """
    found: list[int] = []
    for part in parts:
        low, high = rows.agg(F.min(part), F.max(part)).first()
        shift = max(0, -(-(low ^ high).bit_length() // DIGIT) * DIGIT) if (low < 0) == (high < 0) else 64
        value = (low + (1 << 63)) >> shift << shift if shift < 64 else 0
        unsigned = part.bitwiseXOR(F.lit(-(1 << 63)))
        while shift:
            shift -= DIGIT
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            for d, n in sorted(tuple(r) for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()):
                if k <= n:
                    break
                k -= n
            value |= d << shift
            rows = rows.filter(digit == d)
        found.append(value - (1 << 63))
    return found


def up_to(parts: list[Column], key: list[int]) -> Column:
    """Whether a row's key is at most this key."""
    out = F.lit(True)
    for part, v in reversed(list(zip(parts, key, strict=True))):
        out = (part < F.lit(v)) | ((part == F.lit(v)) & out)
    return out


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank 1, 2, 3... in this order: sorted by ranges, numbered within each, and raised by the counts of the ranges before (one row a range on the driver)."""
    at = stage(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, seen = [], 0
    for p, n in sizes:
        before.append((p, seen))
        seen += n
    offsets = at.sparkSession.createDataFrame(before, "part long, before long")
    placed = at.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs (doc_id, text): rank 1, 2, 3... of the drawn, null for the others.

    Of the N rows with at least least_words words, floor(percent * N / 100) with the highest scores are drawn, ties to
    smaller ids, a null id last; rows alike in both are told apart by a row number, so the draw's size is always exact.
    Null texts have no words; without features the weight is 0; an empty target has equal shares; an empty table gives
    an empty result. Very long texts pass whole, one at a time; other columns play no part whatever their names.
    """
    gain = gains(counts(docs, buckets), counts(target, buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    parts = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("row")]
    drawn = (F.col("n_words") >= least_words) & up_to(parts, kth_key(able.select("score", "doc_id", "row"), parts, k))
    ranked = in_order(scored.filter(drawn), parts)
    rest = scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)
