"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows are hash-joined, and slots must map consistently. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import all_columns, free_name, stage

WIDTH = 5
#: Units that follow a number; fixed values.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|s|ms|min|h|hours|minutes|seconds|days|years|usd|eur|gbp|dollars|euros|cents|percent|meters|metres|miles|feet|inches|litres|liters|grams|kilograms|°c|°f|%|€|\\$|£"
#: Above so many distinct windows (8 bytes each) the benchmark's hashes aren't broadcast but joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Words by which windows of one occurrence may be shifted against each other: names have more or fewer words.
DRIFT = 8


def canonical(text: Column) -> Column:
    """The text's words as template words: a slot is ``<n>``, ``<p>`` or ``<u>`` and then its own value, ``<s>`` marks a capitalised word that starts a sentence.

    A new line ends a sentence. A capitalised word (its second letter a small one) that doesn't start a sentence is a
    name; digits with separators are a number; a unit right after a number is a unit. All is in lower case, without
    punctuation. The patterns begin with the character that they look for, so that most positions fail at once.
    """
    t = F.translate(F.replace(F.translate(text, "<>", ""), F.lit("\n"), F.lit(". ")), "\t\x0b\f\r", "    ")
    t = F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    t = F.regexp_replace(t, r"\p{Lu}(?<=[^.!?: ] ?.)(?<= .)\p{Ll}[\p{L}\p{M}'’-]*", "<p>$0")
    t = F.regexp_replace(t, r"\p{Lu}(?<=(?:^|[ \"“„«(]).)\p{Ll}[\p{L}\p{M}'’-]*", "<s>$0")
    t = F.regexp_replace(t, r"\p{N}(?<![\p{L}\p{N}].)\p{N}*(?:[.,]\p{N}+)*", "<n>$0")
    t = F.regexp_replace(t, rf"(?i)(<n>[\p{{N}}.,]+ ?)((?:{UNITS})(?![\p{{L}}\p{{N}}]))", "$1<u>$2")
    return F.split(F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}<> ]+", "")), " +")


def kind(word: Column, starts: str | None = None) -> Column:
    """A template word without a slot's value; the first word of a sentence as it is, or as a slot of the type starts."""
    first = F.substring(word, 4, 2_147_483_647) if starts is None else F.lit(starts)
    return F.when(word.startswith("<s>"), first).when(word.startswith("<"), F.substring(word, 1, 3)).otherwise(word)


def plain(word: Column) -> Column:
    """A template word's own value."""
    return F.when(word.startswith("<"), F.substring(word, 4, 2_147_483_647)).otherwise(word)


#: What a word is, in the two lowest bits of its hash.
LITERAL, SLOT, START, EMPTY = 0, 1, 2, 3


def _windows(docs: DataFrame, id_column: str, width: int, short: list[int], whole: bool = False) -> DataFrame:
    """(id, row, at, h, w, p, slots): hashes h of each window, row being a hash of id and text.

    h is the template's hash, with first words of sentences as they are and once more as names (each if it has two
    literal words at least; w is the former), and the hash p of the plain words, also those of the lengths in short (if
    whole, of a text of that length only). slots are the window's words where it has a mark. Each word is hashed once;
    windows then combine whole numbers, and their words are taken only where they are used.
    """
    d = docs.select(F.col(id_column).alias("id"), F.xxhash64(id_column, "text").alias("row"), canonical(F.coalesce("text", F.lit(""))).alias("t"))
    clear = lambda h: h.bitwiseAND(F.lit(-4))
    what = lambda x: F.when(x == "", EMPTY).when(x.startswith("<s>"), START).when(x.startswith("<"), SLOT).otherwise(LITERAL)
    d = d.select("id", "row", "t", F.transform("t", lambda x: clear(F.xxhash64(kind(x))).bitwiseOR(what(x).cast("long"))).alias("k"), F.transform("t", lambda x: clear(F.xxhash64(plain(x)))).alias("q"))
    shifted = lambda c: [F.col(c), *(F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))) for k in range(1, width))]
    zipped = F.arrays_zip(*[x.alias(f"{c}{k}") for c in ("k", "q") for k, x in enumerate(shifted(c))])
    w = d.select("id", "row", "t", F.posexplode(zipped).alias("at", "w"))
    w = w.select("id", "row", "t", "at", *[F.col(f"w.{c}{k}") for c in ("k", "q") for k in range(width)])
    words, plains = [F.col(f"k{k}") for k in range(width)], [F.col(f"q{k}") for k in range(width)]
    some = lambda *kinds: sum((F.when(c.bitwiseAND(F.lit(3)).isin(*kinds), 1).otherwise(0) for c in words), F.lit(0))
    full = words[-1].isNotNull()
    w = w.select(
        "id", "row", "t", "at", *words, *plains, some(SLOT, START).alias("marks"), some(START).alias("starts"), some(LITERAL).alias("literal"),
        F.xxhash64(*[clear(c) for c in words]).alias("strict"), F.xxhash64(*plains).alias("plain"),
    )
    nothing = F.lit(None).cast("long")
    strict = F.when(F.col("literal") + F.col("starts") >= 2, F.col("strict"))
    as_is = F.when(F.col("strict") == F.col("plain"), F.col("plain"))
    one = lambda h, w, p: F.struct(h.alias("h"), w.alias("w"), p.alias("p"))
    none = one(nothing, nothing, nothing)
    name = clear(F.xxhash64(F.lit("<p>")))
    as_names = F.xxhash64(*[F.when(c.bitwiseAND(F.lit(3)) == START, name).otherwise(clear(c)) for c in words])
    first = F.when(full & strict.isNotNull(), one(strict, strict, as_is)).otherwise(none)
    more = [
        F.when(full & strict.isNotNull() & (F.col("starts") > 0) & (F.col("literal") >= 2), one(as_names, strict, nothing)).otherwise(none),
        F.when(full & (strict.isNull() | as_is.isNull()), one(F.col("plain"), nothing, F.col("plain"))).otherwise(none),
    ]
    for k in short:
        h = F.xxhash64(*plains[:k])
        more.append(F.when((F.size("t") == k) & (F.col("at") == 0) if whole else words[k - 1].isNotNull(), one(h, nothing, h)).otherwise(none))
    simple = full & (F.col("marks") == 0) & strict.isNotNull() & as_is.isNotNull()
    hashes = F.array(first, *more) if short else F.when(simple, F.array(first)).otherwise(F.array(first, *more))
    slots = F.when(F.col("marks") > 0, F.slice("t", F.col("at") + 1, width))
    return w.select("id", "row", "at", slots.alias("slots"), F.explode(hashes).alias("x")).filter("x.h is not null").select("id", "row", "at", "x.*", "slots")


def _rarest(windows: DataFrame, name: str, share: float) -> DataFrame:
    """(item_id, h): of each item's distinct values of name those that the fewest items share, as many as any document with share of them must hold one of."""
    item = Window.partitionBy("item_id")
    v = windows.filter(F.col(name).isNotNull()).groupBy("item_id", name).agg(F.max("shared").alias("shared"))
    v = v.select("item_id", name, F.row_number().over(item.orderBy("shared", name)).alias("place"), F.count("*").over(item).alias("n"))
    v = v.filter(F.col("place") <= F.col("n") - F.ceil(share * F.col("n")) + 1)
    return windows.join(v, ["item_id", name], "left_semi").select("item_id", "h")


def _mapping(matches: DataFrame, *key: str) -> DataFrame:
    """(key, n, consistency) of matched windows: the distinct slot values of the item, by type, and the share that map to a single value; no row for keys without slots."""
    starts = lambda z, mark: z["now"].startswith(mark) | z["was"].startswith(mark)
    slot = lambda z: starts(z, "<") & ~(starts(z, "<s>") & (plain(z["now"]) == plain(z["was"])))
    typed = lambda c: F.replace(c, F.lit("<s>"), F.lit("<p>"))
    slots = matches.filter("w is not null and slots is not null and item_slots is not null")
    z = slots.select(*key, F.explode(F.filter(F.arrays_zip(F.col("slots").alias("now"), F.col("item_slots").alias("was")), slot)).alias("z"))
    z = z.select(*key, typed(F.col("z.was")).alias("was"), typed(F.col("z.now")).alias("now"))
    one = z.groupBy(*key, "was").agg(F.min("now").alias("least"), F.max("now").alias("most"))
    return one.groupBy(*key).agg(F.count("*").alias("n"), (F.sum((F.col("least") == F.col("most")).cast("long")) / F.count("*")).alias("consistency"))


def _aligned(matches: DataFrame, share: float) -> DataFrame:
    """(row, item_id, aligned): the best consistency of an occurrence that holds share of the item's windows; no row if there is none.

    An occurrence has one shift between the document's and the item's positions, DRIFT words apart at most; of an
    item's window its nearest match counts. Matches meet the shifts of their own stretch of positions and its two
    neighbours, so the work is linear in the matches however often a text repeats an item, and an occurrence's group
    is no larger than the item allows.
    """
    key = ["row", "item_id", "d"]
    m = matches.select("row", "item_id", "n_windows", "w", "item_at", "shift", "slots", "item_slots").distinct()
    area = lambda c: F.floor(F.col(c) / (2 * DRIFT + 1))
    shifts = m.select("row", "item_id", F.col("shift").alias("d")).distinct()
    shifts = shifts.withColumn("area", F.explode(F.sequence(area("d") - 1, area("d") + 1)))
    near = m.withColumn("area", area("shift")).join(shifts, ["row", "item_id", "area"]).filter(F.abs(F.col("shift") - F.col("d")) <= DRIFT).drop("area")
    near = near.withColumn("far", F.abs(F.col("shift") - F.col("d"))).withColumn("least", F.min("far").over(Window.partitionBy(*key, "item_at"))).filter("far = least")
    held = near.groupBy(*key, "n_windows").agg(F.size(F.collect_set("w")).alias("held")).filter(F.col("held") >= share * F.col("n_windows"))
    judged = held.select(*key).join(_mapping(near, *key), key, "left")
    return judged.groupBy("row", "item_id").agg(F.max(F.coalesce("consistency", F.lit(1.0))).alias("aligned"))


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, share: float) -> DataFrame:
    """find_leaks() with the row's hash."""
    items = benchmark.select("item_id", "text").filter("item_id is not null")
    sizes = items.select(F.size(canonical(F.coalesce("text", F.lit("")))).alias("n")).filter(F.col("n").between(2, width - 1)).distinct()
    short = sorted(r.n for r in sizes.collect())
    b = _windows(items, "item_id", width, short, True).select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "h", "w", "p", F.col("slots").alias("item_slots"))
    b = stage(b, "item_windows")
    keys = stage(b.groupBy("h").agg(F.count_distinct("item_id").alias("shared")), "window_counts")
    known = F.broadcast(keys.select("h")) if keys.count() <= BROADCAST_WINDOWS else keys.select("h")
    seen = _windows(docs.select("doc_id", "text"), "doc_id", width, short).join(known, "h", "left_semi")
    seen = stage(seen.select("row", F.col("id").alias("doc_id"), "at", "h", "slots"), "seen_windows")
    counted = b.join(keys, "h")
    rare = _rarest(counted, "w", share).union(_rarest(counted, "p", share)).distinct()
    pairs = seen.join(rare, "h").select("row", "doc_id", "item_id").distinct()
    hits = pairs.join(b, "item_id").join(seen.select("row", "at", "h", "slots"), ["row", "h"])
    hits = stage(hits.select("row", "doc_id", "item_id", "w", "p", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "slots", "item_slots"), "matches")
    whole = b.groupBy("item_id").agg(F.count_distinct("w").alias("n_windows"), F.count_distinct("p").alias("n_plain"))
    size = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  (at most the item's windows)
    found = hits.groupBy("row", "doc_id", "item_id").agg(size("w").alias("n_shared"), size("p").alias("n_same")).join(whole, "item_id")
    verbatim = (F.col("n_plain") > 0) & (F.col("n_same") >= share * F.col("n_plain"))
    found = found.withColumn("verbatim", verbatim).filter(F.col("verbatim") | (F.col("n_windows") > 0) & (F.col("n_shared") >= share * F.col("n_windows")))
    found = stage(found, "found")
    key = ["row", "item_id"]
    judged = found.join(_mapping(hits.join(found.select(*key), key, "left_semi"), *key), key, "left")
    judged = stage(judged.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("consistency", F.coalesce("consistency", F.lit(1.0))), "judged")
    open_ = judged.filter(~F.col("verbatim") & (F.col("consistency") < share)).select(*key, "n_windows")
    judged = judged.join(_aligned(hits.join(open_, key), share), key, "left")
    best = F.when(F.col("verbatim"), 1.0).otherwise(F.greatest("consistency", F.coalesce("aligned", F.lit(0.0))))
    of = lambda same, template: F.when(F.col("verbatim") & (F.col("n_shared") < share * F.col("n_windows")) | (F.col("n_windows") == 0), F.col(same)).otherwise(F.col(template))
    out = judged.select("row", "doc_id", "item_id", of("n_plain", "n_windows").alias("n_windows"), of("n_same", "n_shared").alias("n_shared"), F.col("n").alias("n_slots"), best.alias("consistency"))
    out = out.withColumn("coverage", F.col("n_shared") / F.col("n_windows")).select("row", "doc_id", "item_id", "n_windows", "n_shared", "coverage", "n_slots", "consistency")
    return out.filter(F.col("consistency") >= share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_windows, n_shared, coverage, n_slots, consistency): documents that hold a benchmark item, its parameters changed or not.

    An item is held if ``share`` of its distinct template windows occur in the document and, where slots take part,
    ``share`` of its slot values (each distinct one, by type) map to a single value, of the document or of one
    occurrence in it that holds ``share`` of the windows. First words of sentences match as words and as names. An
    item is held too if ``share`` of its windows of plain lower-case words occur (the counts are theirs if the
    template's fall short). Items of two words up to ``width`` are one window of plain words. Items of one word, and
    empty or null texts, take no part; those whose windows all lack literal words are found verbatim only. Rows are judged each alone, those that share an
    id too; rows alike in id and text give one row. Empty tables give an empty result, other columns play no part.
    Rows of one item_id are one item; items without an id take no part. Windows of documents meet the benchmark's by
    their hashes alone, which are broadcast only after they have been counted, up to BROADCAST_WINDOWS. Then those of
    an item's windows that the fewest items share, more than 1 - share of them, say which documents may hold it, so a
    window that many items share is paired with items only where a rarer one of theirs is there too; only such pairs
    are compared in full.
    """
    return _leaks(docs, benchmark, width, share).drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a benchmark item, rows without an id and repeated rows too; null and empty texts stay.

    The rows' hashes of id and text are written, counted, and broadcast up to BROADCAST_WINDOWS. Columns may have any names.
    """
    row = free_name(docs, "__row")
    bad = stage(_leaks(docs, benchmark, how.get("width", WIDTH), how.get("share", 0.8)).select(F.col("row").alias(row)).distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_WINDOWS else bad
    return docs.withColumn(row, F.xxhash64("doc_id", "text")).join(bad, row, "left_anti").select(*all_columns(docs))
