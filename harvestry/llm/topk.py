"""Exact top-k by integer inner product with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, QUERIES, BLOCK = 1024, 256, 64
#: Vectors of a cell and queries of a group, at most about so many: what a task holds.
CELL, GROUP = 1 << 16, 1 << 16
#: At most about so many bytes of components in a packed row, and in a cell or group; longer vectors make them smaller.
ROW_BYTES, CELL_BYTES = 1 << 19, 1 << 25
PACKED = "ids binary, dims int, ints binary"
#: Up to this bound the products and their sums are exact in doubles.
EXACT = 2.0**53


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids, dims, ints): up to size vectors each, as little-endian int64 matrices padded with 0 to the longest."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        dims = max((len(v) for v in vectors), default=0)
        m = np.zeros((len(ids), dims), np.int64)
        for r, v in zip(m, vectors, strict=True):
            r[: len(v)] = v
        out = pa.RecordBatch.from_pylist([{"ids": np.array(ids, np.int64).tobytes(), "dims": dims, "ints": m.tobytes()}], pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("ints", pa.binary())]))
        ids.clear()
        vectors.clear()
        return out

    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or x is None or None in x:
                continue
            v = np.array(x, np.float64)
            if not np.isfinite(v).all():
                continue
            ids.append(i)
            vectors.append(np.clip(np.floor(256.0 * v), -(2.0**62), 2.0**62).astype(np.int64))
            if len(ids) == size:
                yield flush()
    if ids:
        yield flush()


class Index:
    """A chunk of vectors: its forward index in blocks of id ranges, and each block's largest and smallest value of each term."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, block: int = BLOCK) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.ints = ids[order], ints[order]
        cuts = np.arange(0, len(ids), block)
        self.cuts = np.append(cuts, len(ids))
        self.most, self.least = np.maximum.reduceat(self.ints, cuts), np.minimum.reduceat(self.ints, cuts)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows; beyond what doubles and int64 hold exactly, by Python's integers, kept within a long."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2.0**63:
        return a @ b.T
    wide = a.astype(object) @ b.T.astype(object)
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, int(x))), otypes=[np.int64])(wide)


def search_chunk(q_ids: np.ndarray, q: np.ndarray, index: Index, best: dict[int, list[tuple[int, int]]], k: int) -> int:
    """Bring best (query -> its (-score, id) in order) up to date with a chunk; returns how many blocks were scored.

    Blocks are taken in order of the sum of their term maxima for the query (minima where the query's term is
    negative); a query stops once the next bound is below its kth score. A bound equal to it may still hold a smaller id.
    """
    dims = min(q.shape[1], index.ints.shape[1])
    q = q[:, :dims]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds = _scores(up, index.most[:, :dims]) .astype(np.float64) + _scores(down, index.least[:, :dims]).astype(np.float64)
    bounds += np.abs(bounds) * 2.0**-50  # sums of large integers are rounded: never below the true bound
    order = np.argsort(-bounds, axis=1, kind="stable")
    scored = 0
    for r, qid in enumerate(q_ids.tolist()):
        top = best.setdefault(qid, [])
        at, step = 0, 1
        while at < order.shape[1]:
            kth = -top[k - 1][0] if len(top) >= k else None
            go = order[r, at : at + step]
            if kth is not None:
                go = go[bounds[r, go] >= kth]
                if not len(go):
                    break
            rows = np.concatenate([np.arange(index.cuts[b], index.cuts[b + 1]) for b in go.tolist()])
            s = _scores(q[r : r + 1], index.ints[rows, :dims])[0]
            scored += len(go)
            ids = index.ids[rows]
            keep = ids != qid
            if kth is not None:
                keep &= s >= kth
            s, ids = s[keep], ids[keep]
            if len(s) > k:
                near = np.lexsort((ids, -s))[:k]
                s, ids = s[near], ids[near]
            top += zip((-s).tolist(), ids.tolist(), strict=True)
            top.sort()
            del top[k:]
            at, step = at + step, min(2 * step, 16)
    return scored


def _search(vectors: pa.Table, queries: pa.Table, k: int) -> tuple[pa.Table, int, int]:
    """Each query's k best of the vectors, and how many blocks were scored, of how many. Both tables hold packed rows."""
    best: dict[int, list[tuple[int, int]]] = {}
    scored = total = 0
    asked = []
    for row in queries.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        asked.append((ids, np.frombuffer(row["ints"], np.int64).reshape(len(ids), row["dims"])))
    for j in range(vectors.num_rows):
        row = vectors.slice(j, 1).to_pylist()[0]
        ids = np.frombuffer(row["ids"], np.int64)
        index = Index(ids, np.frombuffer(row["ints"], np.int64).reshape(len(ids), row["dims"]))
        for q_ids, q in asked:
            scored += search_chunk(q_ids, q, index, best, k)
            total += len(q_ids) * len(index.most)
    rows = [(q, i, -s) for q, top in best.items() for s, i in top]
    return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"]), scored, total


def fit_in(most: int, size: int, dims: int | None) -> int:
    """How many vectors of dims components fit in size bytes: 1 at least, most at most."""
    return min(most, max(1, size // (8 * max(1, dims or 1))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, cells: int | None = None, groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id, its own row left out.

    vectors: (vec_id, embedding). Components become floor(256 x). Vectors that are null or hold null or non-finite
    components, and null ids, take no part; missing components of shorter vectors count 0 (an empty vector scores 0).
    Repeated rows each count; an empty table gives an empty result; other columns play no part.

    Vectors are packed in chunks of CHUNK, which lie in cells, queries in chunks of QUERIES, which lie in groups; both
    are counted first, and the longest vector is measured, so that a cell holds about CELL vectors and a group about
    GROUP queries, fewer where they would take more than CELL_BYTES (chunks: ROW_BYTES), whatever the table's
    size. Each pair of a cell and a group is one co-grouped task of bounded memory: vectors are shipped once a group
    and queries once a cell. Within a task the running kth score of one chunk prunes the blocks of the next ones; the
    best of all tasks are merged by query.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = v.filter(is_query)
    n, q, dims = v.agg(F.count("*"), F.count_if(is_query), F.max(F.size("embedding"))).first()
    cells = cells or max(8, -(-n // fit_in(CELL, CELL_BYTES, dims)))
    groups = groups or max(1, -(-q // fit_in(GROUP, CELL_BYTES, dims)))
    chunk, asks = fit_in(CHUNK, ROW_BYTES, dims), fit_in(QUERIES, ROW_BYTES, dims)
    one_of = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = v.mapInArrow(lambda b: _pack(b, chunk), PACKED).withColumn("cell", one_of(cells)).withColumn("part", every(groups))
    asked = asked.mapInArrow(lambda b: _pack(b, asks), PACKED).withColumn("part", one_of(groups)).withColumn("cell", every(cells))
    both = packed.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part"))
    found = both.applyInArrow(lambda x, y: _search(x, y, k)[0], "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
