"""Range asymmetric numeral systems over a static table, with interleaved lanes: blocks of token ids to bytes and back.

A block is ``HVR1``, then little-endian: version u16, lanes u16, bits u8, a zero byte, table checksum u32, tokens u32,
ids' crc32 u32, checkpoint interval in steps u32, checkpoints u32, words u32; the lanes' first states u64; for each
checkpoint the word offset u32 and the lanes' states u64; the words u32; a crc32 of all that stands before.
Token i is coded by lane i mod lanes in step i div lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION, BITS, LANES, EVERY = b"HVR1", 1, 20, 4096, 64
#: Steps that a block has at least, if it isn't shorter: with so many tokens a lane its 8-byte state is a small part.
STEPS = 128
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHBxIIIIII")


class Table:
    """Shared frequencies of ids 0..n-1, each 1 at least, that sum to 2**BITS."""

    def __init__(self, counts: np.ndarray, bits: int = BITS) -> None:
        total = 1 << bits
        counts = np.asarray(counts, np.float64)
        if len(counts) > total // 4:
            raise ValueError(f"{len(counts)} ids need more than {bits} bits")
        spare = total - len(counts)
        freq = 1 + np.floor(counts / max(counts.sum(), 1) * spare).astype(np.int64)
        freq[int(np.argmax(counts))] += total - freq.sum()
        self._fill(freq, bits)

    def _fill(self, freq: np.ndarray, bits: int) -> None:
        if freq.sum() != 1 << bits or freq.min() < 1:
            raise ValueError("frequencies must be 1 at least and sum to the table's size")
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.check = zlib.crc32(freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id at each slot, for decoding."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None}


    @classmethod
    def of(cls, freq: np.ndarray, bits: int) -> Table:
        """The table with these frequencies, as written beside blocks."""
        out = cls.__new__(cls)
        out._fill(np.asarray(freq, np.int64), bits)
        return out


def encode(ids: np.ndarray, table: Table, lanes: int | None = None, every: int = EVERY) -> bytes:
    """A block. Without lanes they follow the block's size, so that their states stay a small part of it."""
    n = len(ids)
    lanes = max(1, min(lanes or min(LANES, n // STEPS), n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    bits, shift = np.uint64(table.bits), np.uint64(32)
    freq, start, limit = table.freq[ids], table.start[ids], table.limit[ids]
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []  # words written when the decoder has done so many steps, counted from the end
    written = 0
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: hi - lo], freq[lo:hi]
        over = np.flatnonzero(x >= limit[lo:hi])
        if len(over):
            words.append(x[over].astype(np.uint32))
            written += len(over)
            x[over] >>= shift
        q = x // f
        state[: hi - lo] = (q << bits) + (x - q * f) + start[lo:hi]
        if step and step % every == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = _HEAD.pack(MAGIC, VERSION, lanes, table.bits, table.check, n, zlib.crc32(ids.astype("<u4").tobytes()), every, len(marks), len(stream))
    parts = [head, state.astype("<u8").tobytes()]
    for done, s in reversed(marks):
        parts += [struct.pack("<I", len(stream) - done), s.astype("<u8").tobytes()]
    body = b"".join([*parts, stream.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def checkpoints(block: bytes) -> int:
    """From how many places a block can be decoded: its start and its checkpoints."""
    return 1 + _HEAD.unpack_from(block)[8]


def decode(block: bytes, table: Table, checkpoint: int = 0, only: bool = False) -> np.ndarray:
    """The block's ids, from the given checkpoint on (0: all), up to the next one if only. ValueError for a damaged block or another table."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    magic, version, lanes, bits, check, n, crc, every, marks, size = _HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION or bits != table.bits or check != table.check:
        raise ValueError("not a block of this table")
    at = _HEAD.size
    state = np.frombuffer(block, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    points = {0: (0, state)}
    for k in range(marks):
        points[k + 1] = (struct.unpack_from("<I", block, at)[0], np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64))
        at += 4 + 8 * lanes
    stream = np.frombuffer(block, "<u4", size, at).astype(np.uint64)
    pos, state = points[checkpoint][0], points[checkpoint][1].copy()
    first = checkpoint * every
    last = min(-(-n // lanes), first + every) if only else -(-n // lanes)
    out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.int32)
    mask, shift, word = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    slots, freq, start = table.slots, table.freq, table.start
    for step in range(first, last):
        if step > first and step % every == 0:
            mark = points[step // every]
            if mark[0] != pos or not np.array_equal(mark[1], state):
                raise ValueError(f"checkpoint {step // every} doesn't match")
        lo, hi = (step - first) * lanes, min(len(out), (step - first + 1) * lanes)
        x = state[: hi - lo]
        slot = x & mask
        ids = slots[slot]
        out[lo:hi] = ids
        x = freq[ids] * (x >> shift) + slot - start[ids]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << word) | stream[pos : pos + len(low)]
            pos += len(low)
        state[: hi - lo] = x
    if not checkpoint and not only and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("ids don't match their checksum")
    return out
