"""Exact duplicates by Grace hashing: records are dealt to spill files by hash until a bucket fits an open-addressing table that compares whole contents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .textnum import pieces

#: Bytes of different contents that a table holds: of a part of the input, or of a bucket.
TABLE_BYTES = 32 << 20
#: Up to so many hashes (8 bytes each) are broadcast, after they were counted; beyond, the join is shuffled.
BROADCAST_HASHES = 1_000_000
_BLANKS = b" \t\n\x0b\x0c\r"


class Table:
    """Contents by open addressing with linear probing; a slot's hash only says which contents are worth comparing, equal ones are equal byte for byte."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self.slots, self.held, self.bytes = [-1] * slots, [], 0

    def put(self, h: int, content: bytes, name: int) -> int:
        """The name under which this content was put first, now if it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            other, known, first = self.held[k]
            if other == h and known == content:
                return first
            at = (at + 1) & mask
        self.slots[at] = len(self.held)
        self.held.append((h, content, name))
        self.bytes += len(content)
        if 2 * len(self.held) > len(self.slots):
            self._grow()
        return name

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, (h, _, _) in enumerate(self.held):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def digest(content: Column, level: int) -> Column:
    """The hash that deals contents at a level of the recursion; each level's is another one."""
    return F.xxhash64(F.lit(level), content)


def normalised(text: str) -> bytes:
    """The text's UTF-8 bytes without ASCII white space."""
    return text.encode().translate(None, _BLANKS)


def records(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(row, doc_id, n_chars, entry, sha, content) for each row of docs: row numbers it, entry is the row that first held its content in this part of the input, and only that row has sha and content.

    So copies leave one content each part of about table_bytes, however many they are.
    """

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, table = TaskContext.get().partitionId() << 33, Table()
        for batch, texts in pieces(batches):
            rows, entries, shas, contents = range(row, row + len(texts)), [], [], []
            for r, text in zip(rows, texts, strict=True):
                content = normalised(text)
                if table.bytes >= table_bytes:
                    table = Table()
                entry = table.put(hash(content), content, r)
                entries.append(entry)
                shas.append(hashlib.sha256(content).digest() if entry == r else None)
                contents.append(content if entry == r else None)
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(entries, pa.int64()), pa.array(shas, pa.binary()), pa.array(contents, pa.binary())],
                ["row", "doc_id", "n_chars", "entry", "sha", "content"],
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(collapsed, "row long, doc_id long, n_chars long, entry long, sha binary, content binary")


def same_contents(found: pa.Table) -> pa.Table:
    """(entry, class) of one bucket: entries of equal content share a class, the first of them."""
    table, classes = Table(), []
    for h, entry, content in zip(found["h"].to_pylist(), found["entry"].to_pylist(), found["content"], strict=True):
        classes.append(table.put(h, content.as_py(), entry))
    return pa.table({"entry": found["entry"], "class": pa.array(classes, pa.int64())})


def settle(entries: DataFrame, table_bytes: int = TABLE_BYTES, deal: Callable[[Column, int], Column] = digest) -> DataFrame:
    """(entry, class) of entries (entry, content): equal contents have one class.

    Level by level, contents are dealt to buckets by that level's hash, as many as their bytes need. A bucket that fits
    is done in one table. One that doesn't is cut into slices first, in which copies fall together, and what is left
    goes to the next level, whose hash parts different contents. A slice holds two entries at least on average, so
    each level leaves fewer copies; all of a level is written to the shared folder, sizes stay there as rows.
    """
    level, steps = 0, []
    todo = stage(entries.select("entry", "content", F.octet_length("content").alias("size"), F.lit(0).cast("long").alias("bucket")), "entries")
    while True:
        total = todo.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        fan = max(2, min(1 << 20, 2 * total // table_bytes + 1)) if level or total > table_bytes else 1
        dealt = todo.withColumn("h", deal(F.col("content"), level))
        place = F.pmod(F.xxhash64("h"), F.lit(fan))
        dealt = dealt.withColumn("bucket", F.xxhash64("bucket", place) if level else place)
        slices = F.least(F.ceil(F.sum("size") / table_bytes), F.floor(F.count("*") / 2)).cast("long")
        large = stage(dealt.groupBy("bucket").agg(slices.alias("slices"), F.sum("size").alias("bytes")).filter((F.col("bytes") > table_bytes) & (F.col("slices") > 1)).drop("bytes"), "large")
        n = large.count()  # at most total / table_bytes
        large = F.broadcast(large) if n <= BROADCAST_HASHES else large
        sliced = F.coalesce(F.pmod(F.xxhash64("entry"), F.col("slices")), F.lit(0)) if n else F.lit(0)
        placed = (dealt.join(large, "bucket", "left") if n else dealt).withColumn("slice", sliced.cast("long"))
        found = placed.select("bucket", "slice", "h", "entry", "content").groupBy("bucket", "slice").applyInArrow(same_contents, "entry long, class long")
        steps.append(stage(found, "classes"))
        if not n:
            break
        firsts = steps[-1].filter("entry = class").select("entry")
        left = dealt.select("entry", "content", "size", "bucket").join(large.select("bucket"), "bucket", "left_semi")
        todo = stage(left.join(firsts, "entry", "left_semi").select("entry", "content", "size", "bucket"), "entries")
        level += 1
    out = steps[0]
    for s in steps[1:]:
        later = s.select(F.col("entry").alias("class"), F.col("class").alias("last"))
        out = out.join(later, "class", "left").select("entry", F.coalesce("last", "class").alias("class"))
    return out


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, deal: Callable[[Column, int], Column] = digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text).

    Texts are equal when they are identical without ASCII white space; null counts as empty. Of equal ones the row with
    the most code points stays, then the smallest id, an absent id last; of rows alike in both any one, and only it is
    kept. Rows that repeat an id are judged each by its own text. Very long texts pass whole, one at a time where they
    exceed a batch; an empty table gives an empty result; other columns play no part whatever their names.

    records() leaves one content a part of the input; contents whose hash occurs once are alone, the others are
    settled by whole contents. Rows are then joined by entry, so a group of copies is never in one task.
    """
    rows = stage(records(docs, table_bytes).withColumn("h", F.when(F.col("content").isNotNull(), deal(F.col("content"), 0))), "records")
    entries = rows.filter("entry = row")
    shared = stage(entries.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared")
    hashes = F.broadcast(shared) if shared.count() <= BROADCAST_HASHES else shared
    classes = settle(entries.join(hashes, "h", "left_semi").select("entry", "content"), table_bytes, deal)
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    by_entry = rows.groupBy("entry").agg(F.count("*").alias("n"), best, F.max("sha").alias("sha"))
    by_entry = stage(by_entry.join(classes, "entry", "left").withColumn("class", F.coalesce("class", "entry")), "by_entry")
    groups = by_entry.groupBy("class").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    info = by_entry.select("entry", "class", "sha").join(groups, "class").select("entry", "sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    out = rows.select("row", "doc_id", "entry").join(info, "entry")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
