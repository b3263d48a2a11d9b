"""Token ids of a corpus in files of independently coded blocks, and back."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .shared import _kept, give_back, release, stage, stage_path
from .textnum import pieces

#: A block ends with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 19
CACHED = 300_000
#: What the word vocabulary's file says of its splits: none of them crosses white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters beyond those for which Python's lower case and white space agree with the library's normaliser.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")


_RUN = re.compile(r"[.,](?<=[^\w\s].|_.)")  # a mark before a stop or comma; the search begins at those
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class _Known(dict):
    """Ids of each distinct word, as bytes; tokenised when first met. After CACHED words they are set aside until as many others came; those met meanwhile stay."""

    def __init__(self, tokenizer) -> None:
        self.old: dict[str, bytes] = {}
        self.model, self.pre = tokenizer.model, tokenizer.pre_tokenizer
        self.kind, self.code = ("<u2", "H") if tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        if (found := self.old.get(word)) is not None:
            self[word] = found
            return found
        if word.isascii() and word.isalpha():
            found = [t.id for t in self.model.tokenize(word)]
        elif _OTHER.search(word):
            found = [t.id for part, _ in self.pre.pre_tokenize_str(word) for t in self.model.tokenize(part)]
        elif word[-1] in ".," and word[:-1].isalpha():
            return self.setdefault(word, self[word[:-1]] + self[word[-1]])
        elif word.isalpha():
            found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]
        else:
            parts = _PIECE.findall(word)
            if len(parts) > 1:
                return self.setdefault(word, b"".join([self[p] for p in parts]))
            found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]
        out = self[word] = struct.pack(f"<{len(found)}{self.code}", *found)
        return out


class Encoder:
    """Ids of texts as little-endian bytes, by the library.

    For a vocabulary whose splits end at white space, as those of _SPLIT do, each distinct word between blanks is
    tokenised once and kept; its ids don't depend on its neighbours. Others, and texts that hold a special token,
    are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        same = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [n.get("type") for n in (parts["normalizer"] or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and same[0].get("pattern") == {"Regex": _SPLIT} and same[0].get("invert") is True
        self.known = _Known(self.tokenizer)
        self.kind = self.known.kind

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self.whole(text)
        if _OTHER.search(text):
            parts = self.tokenizer.normalizer.normalize_str(text).split(" ")
        else:
            text = text.lower()
            if not _RUN.search(text):  # a mark alone is a piece: apart from it, fewer words are distinct
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
            parts = text.split()
        return b"".join(map(self.known.__getitem__, parts))


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """(shard, seq, doc_id, n_tokens, ids, counts): the rows of docs by ascending doc_id (null first, ties by the text's hash), dealt by ranges.

    shard numbers the ranges and seq the rows in one. ids are little-endian, two bytes each if the vocabulary allows it,
    end_id last. One row more a task, without seq, holds how often each id occurs in it: pairs of id and count, as little-endian i64.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    names = ["shard", "seq", "doc_id", "n_tokens", "ids", "counts"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _kept.get(vocabulary) or _kept.setdefault(vocabulary, Encoder(vocabulary))
        end = np.array([end_id], e.kind).tobytes()
        shard, seq = TaskContext.get().partitionId(), 0
        total = np.zeros(e.size, np.int64)
        for batch, texts in pieces(batches, most=500_000, keep=vocabulary):
            ids = [e.encode(t) + end for t in texts]
            n = len(ids)
            total += np.bincount(np.frombuffer(b"".join(ids), e.kind), minlength=e.size)
            columns = [pa.array([shard] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), batch.column("doc_id"), pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
            seq += n
        there = np.flatnonzero(total)
        pairs = np.stack((there, total[there]), 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], names)

    return ordered.mapInArrow(rows, "shard int, seq long, doc_id long, n_tokens long, ids binary, counts binary")


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, added up from the tasks' counts; what reaches the driver is at most one row an id of the vocabulary."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                pairs = np.frombuffer(c.as_buffer(), "<i8").reshape(-1, 2)
                total[pairs[:, 0]] += pairs[:, 1]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])

    out = np.zeros(size, np.int64)
    counts = tokens.filter("counts is not null").select("counts")
    few = counts.coalesce(max(8, counts.rdd.getNumPartitions() // 32))  # a task adds up many tasks' counts, so that few rows are shuffled
    for r in few.mapInArrow(added, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_blocks(tokens: DataFrame, table: rans.Table, size: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(shard, first_seq, n_tokens, doc_ids, lengths, payload): the file format, a row a block; blocks hold whole documents and stand alone."""
    kind = "<u2" if size <= 1 << 16 else "<u4"
    shared = tokens.sparkSession.sparkContext.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        t = shared.value
        docs: list[tuple[int | None, bytes]] = []
        at, held = (-1, 0), 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in docs), kind)
            row = {"shard": at[0], "first_seq": at[1], "n_tokens": len(ids), "doc_ids": [i for i, _ in docs], "lengths": [len(x) // int(kind[2]) for _, x in docs], "payload": rans.encode(ids, t)}
            docs.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("first_seq", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in batches:
            for shard, seq, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "seq", "doc_id", "ids")), strict=True):
                if docs and (held >= block_tokens or shard != at[0] or seq != at[1] + len(docs)):
                    yield flush()
                if not docs:
                    at, held = (shard, seq), 0
                docs.append((doc, ids))
                held += len(ids) // int(kind[2])
        if docs:
            yield flush()
        give_back()

    return tokens.filter("seq is not null").select("shard", "seq", "doc_id", "ids").mapInArrow(blocks, "shard int, first_seq long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary")


def block_starts(files: DataFrame) -> DataFrame:
    """(shard, first_seq, block_start): all ids before each block. The window without a key runs over one row a shard."""
    blocks = files.select("shard", "first_seq", "n_tokens")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = shards.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, "shard").select("shard", "first_seq", (F.col("base") + F.col("inner")).alias("block_start"))


def _documents(batches: Iterator[pa.RecordBatch], table: rans.Table) -> Iterator[tuple[dict, np.ndarray, list[bytes]]]:
    """Each block of files: its row, where its documents begin, and their ids as little-endian u32."""
    release()
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            ids = rans.decode(r.pop("payload"), table).astype("<u4")
            ends = np.cumsum(r["lengths"])
            if not len(ends) or ends[-1] != len(ids):
                raise ValueError("a block's documents don't add up to its ids")
            begins = ends - r["lengths"]
            yield r, begins, [ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
    give_back()


def _read(files: DataFrame, table: rans.Table, name: str, kind: pa.DataType, made) -> DataFrame:
    """(shard, first_seq, doc_id, inner, n_tokens, name): what ``made`` makes of each document's ids, as they are decoded."""
    shared = files.sparkSession.sparkContext.broadcast(table)
    names = ["shard", "first_seq", "doc_id", "inner", "n_tokens", name]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, begins, ids in _documents(batches, shared.value):
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["first_seq"]] * n, pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(begins), pa.array(r["lengths"], pa.int64()), pa.array(map(made, ids), kind)], names
            )

    sql = "binary" if pa.types.is_binary(kind) else "long"
    return files.mapInArrow(rows, f"shard int, first_seq long, doc_id long, inner long, n_tokens long, {name} {sql}")


def read_blocks(files: DataFrame, table: rans.Table) -> DataFrame:
    """(shard, first_seq, doc_id, inner, n_tokens, ids): each document from its block, ids as little-endian u32."""
    return _read(files, table, "ids", pa.binary(), bytes)


def read_segments(files: DataFrame, table: rans.Table) -> DataFrame:
    """(shard, first_seq, part, ids): each block from each of its checkpoints to the next, ids as little-endian u32; a row a part, so parts of one block may be decoded by different tasks."""
    shared = files.sparkSession.sparkContext.broadcast(table)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [rans.checkpoints(p) for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("first_seq"), pa.array(n, pa.int32())], ["shard", "first_seq", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [rans.decode(p, shared.value, k, True).astype("<u4").tobytes() for p, k in zip(batch.column("payload").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "first_seq", "part")), pa.array(ids, pa.binary())], ["shard", "first_seq", "part", "ids"])

    keys = files.select("shard", "first_seq", "payload").mapInArrow(parts, "shard int, first_seq long, n int").select("shard", "first_seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    return keys.join(files.select("shard", "first_seq", "payload"), ["shard", "first_seq"]).mapInArrow(rows, "shard int, first_seq long, part int, ids binary")


def write_corpus(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """The files of docs in the folder path: ``blocks``, a row a block, and ``table``, the frequencies that decode them.

    Every whole text is tokenised once, a null one as empty; the ids of each row end with end_id. Rows that repeat an
    id each stay, in order of their texts' hashes; rows without an id come first. An empty table gives no block. A
    document of more than block_tokens ids is a block of its own. Other columns play no part. The stage table with the
    ids is coded after its counts are added up. Writers and readers handle a block at a time.
    """
    size = Encoder(vocabulary).size
    if not 0 <= end_id < size:
        raise ValueError("end_id isn't in the vocabulary")
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, vocabulary, end_id), "tokens")
    table = rans.Table(id_counts(tokens, size))
    row = [(table.bits, bytearray(table.freq.astype("<u4").tobytes()), table.check)]
    spark.createDataFrame(row, "bits int, freq binary, checksum long").coalesce(1).write.parquet(f"{path}/table")
    write_blocks(tokens, table, size, block_tokens).write.parquet(f"{path}/blocks")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, rans.Table]:
    """The blocks of a folder that write_corpus() wrote, and their frequency table; ValueError if the table is damaged."""
    row = spark.read.parquet(f"{path}/table").first()
    table = rans.Table.of(np.frombuffer(bytes(row["freq"]), "<u4"), row["bits"])
    if table.check != row["checksum"]:
        raise ValueError("damaged table")
    return spark.read.parquet(f"{path}/blocks"), table


def encode_corpus(docs: DataFrame, vocabulary: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, rans.Table]:
    """write_corpus() to the shared folder, and what read_corpus() reads from there."""
    path = stage_path(docs.sparkSession, "corpus")
    write_corpus(docs, path, vocabulary, end_id, block_tokens)
    return read_corpus(docs.sparkSession, path)


def digests(files: DataFrame, table: rans.Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files; one worker a task decodes and digests."""
    inner = _read(files, table, "ids_crc32", pa.int64(), zlib.crc32)
    return inner.join(block_starts(files), ["shard", "first_seq"]).select("doc_id", (F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
