"""Near duplicates by ProbMinHash over weighted word shingles, banding, exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import all_columns, free_name, give_back, quoted, stage
from .textnum import mix, pieces, shingles, words

WIDTH, SIMILARITY = 5, 0.8
#: Registers of a signature: BANDS times ROWS. A pair of similarity 0.8 meets in a band with probability 0.9993.
BANDS, ROWS = 24, 6
#: Members of each band's bucket, chosen by hash, that all its members are compared with at first, besides the first by id.
PIVOTS = 3
#: Slots of the counts that order shingles from rare to common.
SLOTS = 1 << 18
#: Words of 64 bits in a set's bitmap.
BITMAP = 8


def weighted(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text and hash, their texts and weights (how often they occur), and a 128-bit hash of each text's words."""
    h, doc = words(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = (np.arange(len(h)) - first[doc]).astype(np.uint64)
    whole = np.zeros((n, 2), np.uint64)
    for k, salt in enumerate((np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))):
        part = mix(h * np.uint64(2 * k + 1) + mix(place * salt + salt))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        whole[:, k] = mix(total[first + count] - total[first] + count.astype(np.uint64) * salt)
    s, d = shingles(h, doc, n, width)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return s[at], d[at], np.diff(np.append(at, len(s))), whole


def signatures(s: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: a row a text, the winning shingle of each register; equal with the probability Jaccard of two texts.

    Each shingle's points arrive as a Poisson process of its weight's rate, seeded by its hash, and each goes to a random
    register, which keeps the earliest. A shingle stops once its next point is later than all registers of its text.
    """
    early = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    at, time, turn = np.arange(len(s)), np.zeros(len(s)), 0
    latest = np.full(n, np.inf)
    while len(at):
        turn += 1
        x = mix(s[at] + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[at]
        alive = time < latest[doc[at]]
        at, time, x = at[alive], time[alive], x[alive]
        cell = doc[at] * registers + (mix(x) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(early, cell, time)
        won = early[cell] == time
        winner[cell[won]] = s[at[won]]
        texts = np.unique(doc[at])
        latest[texts] = early.reshape(n, registers)[texts].max(1)
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of each row, its number included."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(3) + parts[:, :, k])
    return key.view(np.int64)


def jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard of two weighted sets (sorted hashes and weights), and the plain Jaccard of the sets."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    m = int(both.sum())
    plain = m / (len(a) + len(b) - m)
    if not m or x.max() == 1 and y.max() == 1:
        return plain, plain
    xs, ys = x[both].astype(np.float64), y[at[both]].astype(np.float64)
    ratio = xs / ys
    order = np.argsort(ratio)
    xs, ys, ratio = xs[order], ys[order], ratio[order]
    above = x.sum() - np.concatenate(([0], np.cumsum(xs)))[np.searchsorted(ratio, ratio, "left")]  # x of all with at least this ratio, those only in a too
    below = (y.sum() - ys.sum()) + np.concatenate(([0], np.cumsum(ys)))[np.searchsorted(ratio, ratio, "left")]
    return float((1 / (above / xs + below / ys)).sum()), plain


def sketch(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, raw, node, keys): hashes of the text as it is and, in 128 bits, of its words; the band keys, by weighted and by distinct shingles (none if it has no shingle)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, most=400_000):
            s, doc, weight, whole = weighted(texts, width)
            n, some = len(texts), np.bincount(doc, minlength=len(texts)) > 0
            keys = [k if m else [] for k, m in zip(band_keys(signatures(s, doc, weight, n, bands * rows), bands), some, strict=True)]
            again = np.zeros(n, bool)
            again[doc[weight > 1]] = True
            if again.any():  # these meet by plain Jaccard too; without repeated shingles both sets of keys are the same
                mine, place = again[doc], np.cumsum(again) - 1
                plain = band_keys(signatures(s[mine], place[doc[mine]], np.ones(int(mine.sum()), np.int64), int(again.sum()), bands * rows), bands)
                for k, more in zip(np.flatnonzero(again), plain, strict=True):
                    keys[k] = np.union1d(keys[k], more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array([w.tobytes() for w in whole], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "raw", "node", "keys"])

    return with_raw(docs).mapInArrow(sketched, "doc_id long, raw long, node binary, keys array<bigint>")


def with_raw(docs: DataFrame) -> DataFrame:
    """(doc_id, text, raw): raw is the hash of the text as it is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("raw", F.xxhash64("text"))


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, hashes, weights) of docs (id, text): sorted hashes as uint32 and, unless all are 1, weights as uint32; shingles that share a hash count as one."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, most=500_000):
            s, doc, weight, _ = weighted(texts, width)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            hashes, weights = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                h, at = np.unique((s[a:b] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                w = np.bincount(at, weight[a:b], len(h)).astype("<u4")
                hashes.append(h.astype("<u4").tobytes())
                weights.append(w.tobytes() if len(w) and w.max() > 1 else b"")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())], ["id", "hashes", "weights"])

    return docs.mapInArrow(sets, "id long, hashes binary, weights binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(id, key, n, others) from nodes (id, rep, keys): each member of a band's bucket of n, two at least, with the bucket's pivots.

    One pivot is the member with the smallest document id, PIVOTS more are chosen by hashes of the members' ids alone:
    a group that meets in many bands mostly has the same ones in each, so rows grow with the members and neither with
    their square nor with the bands. Buckets of one are gone before the join.
    """
    rows = nodes.select("id", "rep", F.explode("keys").alias("key"))
    pivots = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", "rep").alias("p"), *[F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"q{k}") for k in range(PIVOTS)]).filter("n > 1")
    return rows.select("id", "key").join(pivots, "key").select("id", "key", "n", F.array_distinct(F.array("p", *[f"q{k}" for k in range(PIVOTS)])).alias("others"))


def candidates(met: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: the members of buckets() with their pivots."""
    met = met.select("id", F.explode("others").alias("other")).filter("id <> other")
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def central(met: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: the members of buckets of three and more with their bucket's most linked member, which most of a loose group is near."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rows = met.filter("n > 2").select("id", "key")
    middle = rows.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("m")).select("key", F.col("m.id").alias("other"))
    met = rows.join(middle, "key").filter("id <> other")
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def with_label(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with the label of their id, or the id itself where label has none."""
    return rows.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))


def prefixes(sets: DataFrame, label: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, label, token, size, rest, total, share, again, b0..): the first shingles of each set, in one order for all sets, with its label (its id where it has none), which joins the sets and not their shingles.

    All that two sets share stands at or after their first common shingle. So from there on each has at least
    similarity of its shingles (for plain Jaccard) or of its weight (probability Jaccard is at most the overlap of the
    normalised weights). Rare shingles come first, by counts in SLOTS hashed slots: any order is right, and a
    passage that many texts share stays out of their prefixes while it is less than similarity of a text.

    rest and share are what the set has from the token on, in shingles and as part of its weight; size and total are
    all its shingles and their weight, again is whether one is repeated; b0.. are 64 * BITMAP parities of hashed
    shingles: where two sets differ in k bits, they differ in k shingles at least.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for c in batch.column("hashes"):
                total += np.bincount(np.frombuffer(c.as_buffer(), "<u4") % SLOTS, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    found = sets.select("hashes").mapInArrow(counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(SLOTS, np.int64)
    common[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    names = ["id", "label", "token", "size", "rest", "total", "share", "again", *(f"b{k}" for k in range(BITMAP))]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, of, c, x in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("hashes"), batch.column("weights"), strict=True):
                h, w = np.frombuffer(c.as_buffer(), "<u4"), np.frombuffer(x.as_buffer(), "<u4")
                order = np.lexsort((h, common[h % SLOTS]))
                w = np.ones(len(h), np.int64) if not len(w) else w[order].astype(np.int64)
                rest, share = np.arange(len(h), 0, -1), w[::-1].cumsum()[::-1] / max(w.sum(), 1)
                take = int((np.maximum(rest / max(len(h), 1), share) >= similarity - 1e-9).sum())
                bits = np.packbits(np.bincount((mix(h.astype(np.uint64)) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) % 2 == 1).view("<i8")
                same = lambda v, kind: pa.array(np.full(take, v, kind))
                yield pa.RecordBatch.from_arrays(
                    [same(i, np.int64), same(of, np.int64), pa.array(h[order[:take]].astype(np.int64)), same(len(h), np.int64), pa.array(rest[:take]), same(w.sum(), np.int64), pa.array(share[:take]), same(w.sum() > len(h), bool), *(same(v, np.int64) for v in bits)],
                    names,
                )
        give_back()

    return with_label(sets, label).mapInArrow(first, "id long, label long, token long, size long, rest long, total long, share double, again boolean, " + ", ".join(f"b{k} long" for k in range(BITMAP)))


def left_over(met: DataFrame, label: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of different labels that may reach similarity, among the members of buckets of three and more that still hold different labels.

    A pair is made where a common shingle stands in both prefixes and, by sizes, what follows it and the bitmaps, the
    two may reach similarity; no pair that reaches it fails that. The shorter set's token then stands in the first
    (1 - s) / (1 + s) of it, so tokens that stand there in no set meet nothing.
    """
    rows = with_label(met.filter("n > 2").select("id", "key"), label)
    mixed = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    ids = stage(rows.join(mixed, "key").select("id").distinct(), "unsettled")
    part = 2 * similarity / (1 + similarity)
    early = F.col("rest") >= part * F.col("size") - 1e-6
    tokens = stage(prefixes(sets.join(ids, "id"), label, similarity).withColumn("early", early), "prefixes")
    # Of a pair with different labels one at least lacks its token's most frequent label, so a large group never meets itself.
    shared = tokens.groupBy("token").agg(F.mode("label").alias("most"), F.min("label").alias("x"), F.max("label").alias("y"), F.bool_or(F.col("early") | F.col("again")).alias("some")).filter("x <> y and some").select("token", "most")
    near = tokens.join(shared, "token")
    a, b = near.alias("a"), near.filter("label <> most").alias("b")
    differ = sum((F.bit_count(F.col(f"a.b{k}").bitwiseXOR(F.col(f"b.b{k}"))) for k in range(1, BITMAP)), F.bit_count(F.col("a.b0").bitwiseXOR(F.col("b.b0"))))
    sizes = F.col("a.size") + F.col("b.size")
    plain = (F.least("a.rest", "b.rest") >= part / 2 * sizes - 1e-6) & (differ <= (1 - part) * sizes + 1e-6)
    weighted_ = (F.least("a.share", "b.share") >= similarity - 1e-6) & (differ <= (1 - similarity) * (F.col("a.total") + F.col("b.total")) + 1e-6)
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.label") != F.col("b.label"))
    # Sets with repeats may meet by weight whatever their sizes are. Each pair and token is made once.
    found = [
        a.filter("early").join(b, meet & plain & (F.col("a.size") <= F.col("b.size"))),
        a.join(b.filter("early"), meet & plain & (F.col("b.size") < F.col("a.size"))),
        a.filter("again").join(b, meet & weighted_ & ~plain),
        a.filter("not again").join(b.filter("again"), meet & weighted_ & ~plain),
    ]
    pairs = reduce(DataFrame.union, [f.select("a.id", F.col("b.id").alias("other")) for f in found])
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact probability Jaccard, or plain Jaccard of distinct shingles, reaches similarity."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("hashes").alias(f"h{name}"), F.col("weights").alias(f"w{name}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            columns = [batch.column(c) for c in ("ha", "wa", "hb", "wb")]
            for k in range(batch.num_rows):
                ha, wa, hb, wb = (np.frombuffer(c[k].as_buffer(), "<u4") for c in columns)
                best = max(jaccard(ha, wa if len(wa) else np.ones(len(ha), np.uint32), hb, wb if len(wb) else np.ones(len(hb), np.uint32)))
                if best >= similarity - 1e-9:
                    keep.append(k)
                    out.append(best)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(out, pa.float64())], ["a", "b", "similarity"])
        give_back()

    return full.mapInArrow(measure, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the same label for all linked nodes, by contraction.

    In each round a node points to its smallest neighbour's smallest neighbour; links then join what their ends point to,
    and those within one node, and all but one of several alike, are gone. So links shrink from round to round, however
    large a group; rounds grow with the logarithm of the longest path. All rounds are written to the shared folder.
    """
    links = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    label = None
    while True:
        both = links.select(F.col("a").alias("id"), F.col("b").alias("near")).union(links.select("b", "a"))
        low = stage(both.groupBy("id").agg(F.least("id", F.min("near")).alias("low")), "low")
        root = low.join(low.select(F.col("id").alias("low"), F.col("low").alias("root")), "low").select("id", "root")
        root = stage(root, "root")
        if label is None:
            label = root.select("id", F.col("root").alias("label"))
        else:
            label = stage(label.join(root.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("root", "label").alias("label")), "label")
        ends = links.join(root.select(F.col("id").alias("a"), F.col("root").alias("x")), "a").join(root.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
        links = stage(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return label


def classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """All rows of docs as (doc_id, raw, node), and their texts as (node, label, rep, raw): a text's class, and the smallest id that it has and its hash there."""
    all_rows = stage(sketch(docs, width, bands, rows), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "raw")).alias("first")
    nodes = all_rows.groupBy("node").agg(first, F.max("keys").alias("keys")).select("node", F.col("first.doc_id").alias("rep"), F.col("first.raw").alias("raw"), "keys")
    nodes = stage(nodes.withColumn("id", F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")), "nodes")
    met = stage(buckets(nodes.filter("size(keys) > 0").select("id", F.coalesce("rep", "id").alias("rep"), "keys")), "met")
    pairs = stage(candidates(met), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "rep", "raw"), "id")
    d = with_raw(docs)
    texts = d.join(wanted, (d.raw == wanted.raw) & d.doc_id.eqNullSafe(wanted.rep)).select("id", "text")
    sets = stage(shingle_sets(texts, width).dropDuplicates(["id"]), "sets")
    links = stage(verify(pairs, sets, similarity).select("a", "b"), "verified")
    second = stage(central(met, links).join(pairs, ["a", "b"], "left_anti"), "central")
    links, pairs = links.union(stage(verify(second, sets, similarity).select("a", "b"), "verified")), pairs.union(second)
    more = stage(left_over(met, components(links), sets, similarity).join(pairs, ["a", "b"], "left_anti"), "more")
    label = components(links.union(verify(more, sets, similarity).select("a", "b")))
    return all_rows.select("doc_id", "raw", "node"), with_label(nodes.select("node", "id", "rep", "raw"), label).drop("id")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, n_rows) for each row of docs (doc_id, text): the smallest id of its class, and the rows that share id and text.

    Words are runs of letters and digits in lower case; texts with the same words are copies of each other and are
    compared once. Null texts count as empty, texts without words are copies of each other, and those of fewer than
    width words have one shingle. A null id stays null and counts after all others: class_id is null only where no
    row of the class has an id. Of rows that repeat an id with different texts each is compared with its own text.
    Ties don't occur: a class takes its smallest id. Very long texts are worked through in blocks, an empty table
    gives an empty result, and other columns of docs play no part whatever their names.

    Copies are linked; different texts by candidates(), central() and verify(), and where a bucket's members still
    differ by left_over() and verify(); classes are connected components.
    """
    all_rows, classed = classes(docs, **how)
    smallest = classed.groupBy("label").agg(F.min("rep").alias("class_id"))
    by_node = classed.join(smallest, "label").select("node", "class_id")
    alike = all_rows.groupBy("doc_id", "node").agg(F.count("*").alias("n_rows"))
    out = alike.join(by_node, "node").select("doc_id", "class_id", "n_rows")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).drop("copy")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class of near duplicates: its text with the smallest id.

    Each row is judged by its own text's class, also where its id is repeated. Of an id one row stays: where several
    texts of one id would, the one with the smallest hash. Rows without an id stay. Only rows that stay meet in the join,
    by id and text. Columns may have any names.
    """
    _, classed = classes(docs, **how)
    key, text, row = (free_name(docs, n) for n in ("__id", "__text", "__row"))
    first = classed.filter("rep is not null").groupBy("label").agg(F.min(F.struct("rep", "raw")).alias("first"))
    kept = first.select(F.col("first.rep").alias(key), F.col("first.raw").alias(text))
    here = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text))
    once = Window.partitionBy(key).orderBy(text)
    found = docs.filter(F.col("doc_id").isNotNull()).join(kept, here).withColumn(row, F.row_number().over(once)).filter(F.col(quoted(row)) == 1)
    return found.select(*all_columns(docs)).unionByName(docs.filter(F.col("doc_id").isNull()))
