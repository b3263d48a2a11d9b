"""Texts as arrays of code points: words, their hashes and n-grams for many texts at a time, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import give_back, release

_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK_BYTES = 1_000_000


def alnum_table() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter or digit, else 0."""
    if "alnum" not in _tables:
        t = np.zeros(0x110000, np.uint32)
        for cp in (*range(0x33480), *range(0xE0100, 0xE01F0)):
            ch = chr(cp)
            if ch.isalnum():
                low = ch.lower()
                t[cp] = ord(low[0])
        _tables["alnum"] = t
    return _tables["alnum"]


def letter_table() -> np.ndarray:
    """As alnum_table, but for letters only."""
    if "letter" not in _tables:
        t = alnum_table().copy()
        for cp in np.flatnonzero(t):
            if not chr(cp).isalpha():
                t[cp] = 0
        _tables["letter"] = t
    return _tables["letter"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a 0 after each, and where each text starts."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return cp, starts


def words(texts: list[str], block: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a run of letters and digits, in lower case) and the index of its text, in order.

    Works through the code points in blocks that end between words, so wide arrays stay small for long texts too.
    """
    cp, starts = codes(texts)
    low = alnum_table()[cp]
    inside = low != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    h = np.empty(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(begin, begin[first] + block)))
        at, to = begin[first], end[last - 1]
        up, down = powers(int(to - at) + 1)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum((low[at:to].astype(np.uint64) + np.uint64(1)) * up[: to - at], out=total[1:])
        x, y = begin[first:last] - at, end[first:last] - at
        h[first:last] = mix((total[y] - total[x]) * down[x] + (y - x).astype(np.uint64))
        first = last
    return h, np.searchsorted(starts, begin, side="right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of width words within a text and its text; a text of fewer words is one shingle, one of none has none."""
    if not len(h):
        return h, doc
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = np.arange(len(h)) - first[doc]
    runs = np.zeros(len(h), np.uint64)
    for k in range(width):  # word k of the run, where the text has one
        at = np.minimum(np.arange(len(h)) + k, len(h) - 1)
        there = place + k < count[doc]
        runs = np.where(there, mix(runs * np.uint64(3) + h[at] + np.uint64(k + 1)), runs)
    keep = (place + width <= count[doc]) | (place == 0)
    return runs[keep], doc[keep]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES, rows: int = 2000, keep: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about so many bytes and rows at most (one text at least), with their texts; null is empty. Of what the worker kept from earlier tasks only keep stays."""
    release(keep)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for k, n in enumerate([*sizes, most + 1]):
            if k > start and (size + n > most or k - start >= rows):
                part = batch.slice(start, k - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, size = k, 0
            size += n + 1
    give_back()
