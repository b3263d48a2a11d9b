"""Spelling variants: a symmetric-delete join finds words one letter apart, and each word follows its more frequent form to a root."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .textnum import codes, mix, pieces, powers

LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: A word with one letter deleted stands for one of so many runs, by hash.
DELETES = 97
#: Different words of a task that are held before their counts are sent on.
HELD = 300_000


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, deletes: int = DELETES) -> DataFrame:
    """(word, n) of the texts of docs (doc_id, text): runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased.

    Where deletes divides the crc32 of "<doc_id>:<run>" the run loses the letter at crc32 modulo its length. A shorter
    run than least_letters can't give a word, so the pattern passes it over.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_letters)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch, texts in pieces(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                salt = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), salt)
                    if h % deletes == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least_letters:
                            continue
                    total[word] = total.get(word, 0) + n
            if len(total) >= HELD:
                yield sent()
        yield sent()

    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which word, key, place and whether it is new: of each word itself (place -1), and of it without the letter at each place.

    A key is a hash of the text that is left, from running sums of letters times powers, so a word of n letters costs n
    steps and n rows. Without one of several equal neighbours the same text is left: only the first is new.
    """
    cp, starts = codes(words)
    size = np.array([len(w) for w in words], np.int64)
    up, down = powers(len(cp) + 2)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=total[1:])
    which = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(cp))[cp != 0]
    a, b = starts[which], (starts + size)[which]
    left = (total[at] - total[a]) * down[a] + (total[b] - total[at + 1]) * down[a + 1]
    whole = (total[starts + size] - total[starts]) * down[starts]
    length = np.uint64(0x9E3779B97F4A7C15)
    key = mix(np.concatenate((whole + size.astype(np.uint64) * length, left + (size[which] - 1).astype(np.uint64) * length)))
    new = np.concatenate((np.ones(len(words), bool), (at == a) | (cp[at] != cp[at - 1])))
    place = np.concatenate((np.full(len(words), -1), at - a))
    return np.concatenate((np.arange(len(words)), which)), key.view(np.int64), place.astype(np.int32), new


def keys(words: DataFrame) -> DataFrame:
    """(id, key, place, new) of words (id, word), see deletions()."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches, "word", most=200_000):
            which, key, place, new = deletions(found)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which)), pa.array(key), pa.array(place), pa.array(new)], ["id", "key", "place", "new"])

    return words.select("id", "word").mapInArrow(emit, "id long, key long, place int, new boolean")


def near(words: DataFrame) -> DataFrame:
    """(id, near_word, near_n), both ways, of words (id, word, n) that differ by exactly one inserted, deleted or replaced code point.

    Two words that differ in one letter leave the same text without it at the same place; one with a letter more leaves
    the other. So equal keys at equal places meet, and deletions meet whole words; nothing else is tried, and what
    meets is verified, as keys are hashes. A text and place has no more words than there are letters (90), and a word
    no more with a letter more than 90 times its places, so no key is hot.
    """
    emitted = stage(keys(words), "keys")
    a, b = emitted.alias("a"), emitted.alias("b")
    replaced = a.filter("place >= 0").join(b.filter("place >= 0"), (F.col("a.key") == F.col("b.key")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.id") < F.col("b.id")))
    longer = a.filter("place < 0").join(b.filter("place >= 0 and new"), F.col("a.key") == F.col("b.key"))
    pairs = replaced.union(longer).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    side = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}"), F.col("n").alias(f"n_{k}"))
    links = pairs.join(side("x"), "x").join(side("y"), "y").filter(F.levenshtein("word_x", "word_y", 1) == 1)
    both = F.explode(F.array(*[F.struct(F.col(p).alias("id"), F.col(f"word_{q}").alias("near_word"), F.col(f"n_{q}").alias("near_n"), F.col(q).alias("near_id")) for p, q in ("xy", "yx")]))
    return links.select(both.alias("link")).select("link.*")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of forms (id, form): the last word that its forms lead to.

    Each round a word takes what its present one has taken, so a chain of n steps takes log2(n) rounds; counts at least
    double from form to form, so no chain has more than 63 steps, and none is a ring. Rounds are written to the shared folder.
    """
    root = stage(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = root.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stage(root.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        root = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return root


def variants(docs: DataFrame, times: float = TIMES, **which) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text), see word_counts().

    A word's form is the most frequent of its near words, ties to the smallest in code-point order, if it occurs times
    as often or more; else null. root is where forms lead, the word itself if it has none. Null texts have no words, a
    null id counts as empty text, rows with one id count each, an empty table gives an empty result, and other columns play no
    part whatever their names. Very long texts pass whole, one at a time.
    """
    if times <= 1:
        raise ValueError("a form that occurs no more often could lead back")
    counted = stage(word_counts(docs, **which).withColumn("id", F.monotonically_increasing_id()), "words")
    links = near(counted)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word", "near_id")).alias("first")
    best = links.groupBy("id").agg(F.count("*").alias("n_near"), first)
    known = counted.join(best, "id", "left")
    formed = F.when(-F.col("first.less") >= F.col("n") * F.lit(times), F.col("first"))
    known = stage(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), formed.alias("form")), "known")
    found = roots(known.filter("form is not null").select("id", F.col("form.near_id").alias("form")))
    named = found.join(counted.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = known.join(named, "id", "left")
    return out.select("word", F.col("form.near_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("form.less")).alias("form_n"))
