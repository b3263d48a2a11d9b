"""URL filters by dated lists: entries become validity intervals, and each capture meets those in force at its fetch time. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import all_columns, free_name, quoted, stage

#: The host of a URL: after the scheme and a user's name, before port, path, query and fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a final dot; null if there is none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, day, action add|remove) -> (list, domain, valid_from, valid_to): from an addition to the next change.

    Of several changes on a day the removal counts last; an addition of what is in force changes nothing but splits
    the interval; null fields make an entry void.
    """
    e = entries.filter(F.col("list").isNotNull() & F.col("domain").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    e = e.groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    ordered = Window.partitionBy("list", "domain").orderBy("day")
    e = e.withColumn("valid_to", F.lead("day").over(ordered))
    return e.filter(F.col("action") == "add").select("list", "domain", F.col("day").alias("valid_from"), "valid_to")


#: A (URL, day) of more captures than this is hot: its verdict is joined back in slices of about so many captures.
SLICE_ROWS = 100_000
#: Up to so many hot pairs, those of most captures, get slices. They are broadcast as a hash and a number each; a pair beyond
#: them holds less than this part of all captures.
HOT_PAIRS = 100_000
#: Up to so many listed domains, which are counted first, their names are broadcast to thin out the hosts' suffixes.
BROADCAST_DOMAINS = 1_000_000


def filter_urls(captures: DataFrame, entries: DataFrame, fetched: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each capture with its host, fetch day, the number of entries in force, the longest matching domain and its list, and blocked.

    A capture matches an entry whose domain is its host or a domain above it and whose interval holds the fetch day
    (from inclusive, to exclusive). Of several the longest domain counts, then the latest, then the last list's name.
    Each distinct pair of URL and day is judged once, so a hot URL or host is aggregated before any shuffle on it;
    suffixes that no list names are gone before they are shuffled, if the domains are few enough to be broadcast. Then
    the captures, repeated rows included, get the verdict. A pair of more than slice_rows captures is hot, whether it
    matches or not: its captures are dealt to slices, whose number grows with their count, and its verdict is repeated
    for each. The slice is a hash of the row and its partition, so a task that is run again deals its rows alike in
    whatever order they come. A null or hostless URL, or a null day, matches nothing; empty tables give no match or no
    row. New columns get another name where captures has theirs. The verdicts are staged, so this starts a job.
    """
    fetch_day, host, n_active, domain, listed, since, blocked, slice_, pair, n_slices = (
        free_name(captures, n) for n in ("fetch_day", "host", "n_active", "domain", "list", "since", "blocked", "__slice", "__pair", "__n_slices")
    )
    rows = captures.withColumn(fetch_day, fetched)
    once = rows.select("url", F.col(fetch_day).alias("day")).filter(host_of(F.col("url")).isNotNull() & F.col("day").isNotNull()).groupBy("url", "day").agg(F.count("*").alias("captures"))
    # no host is without suffixes; the plain explode would filter below the counts, which could then not be shared with ``heavy``
    tried = once.withColumn("domain", F.explode_outer(suffixes(host_of(F.col("url")))))
    valid = intervals(entries)
    names = valid.select("domain").distinct()
    if names.limit(BROADCAST_DOMAINS + 1).count() <= BROADCAST_DOMAINS:
        tried = tried.join(F.broadcast(names), "domain", "left_semi")
    live = tried.join(valid, "domain").filter((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    best = F.max(F.struct(F.length("domain").alias("size"), F.col("valid_from"), F.col("list"), F.col("domain")))
    found = live.groupBy("url", "day").agg(F.count("*").alias("n"), best.alias("best"), F.max("captures").alias("captures"))
    heavy = once.filter(F.col("captures") > slice_rows)
    judged = stage(found.unionByName(heavy, allowMissingColumns=True), "verdicts")
    hot = judged.filter(F.col("captures") > slice_rows).groupBy(F.xxhash64("url", "day").alias(pair)).agg(F.max("captures").alias("n"))
    hot = hot.orderBy(F.col("n").desc(), pair).limit(HOT_PAIRS).select(pair, F.ceil(F.col("n") / slice_rows).cast("int").alias(n_slices))
    verdict = judged.filter("n is not null").withColumn(pair, F.xxhash64("url", "day")).join(F.broadcast(hot), pair, "left")
    verdict = verdict.select(
        F.col("url").alias("u"), "day", F.explode(F.sequence(F.lit(0), F.coalesce(n_slices, F.lit(1)) - 1)).alias("s"),
        F.struct("n", "best.domain", "best.list", "best.valid_from").alias("v"),
    )
    dealt = F.xxhash64(F.to_json(F.struct(*all_columns(captures))), F.spark_partition_id())
    unjudged = host_of(F.col("url")).isNull() | F.col(fetch_day).isNull()
    rows = rows.withColumn(pair, F.xxhash64("url", fetch_day)).join(F.broadcast(hot), pair, "left")
    slice_of = F.when(unjudged, -1 - F.pmod(dealt, F.lit(1 << 30))).when(F.col(n_slices).isNotNull(), F.pmod(dealt, n_slices)).otherwise(0)
    rows = rows.withColumn(slice_, slice_of.cast("int"))
    out = rows.join(verdict, (rows["url"] == verdict["u"]) & (rows[fetch_day] == verdict["day"]) & (rows[slice_] == verdict["s"]), "left")
    return out.select(
        *[rows[quoted(c)] for c in captures.columns], rows[fetch_day], host_of(rows["url"]).alias(host),
        F.coalesce("v.n", F.lit(0)).cast("long").alias(n_active), F.col("v.domain").alias(domain), F.col("v.list").alias(listed),
        F.col("v.valid_from").alias(since), F.col("v.n").isNotNull().alias(blocked),
    )
