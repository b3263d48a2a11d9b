"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import all_columns, quoted, stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Up to so many sources their targets are broadcast, after they were counted; beyond, the join is shuffled.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_bucket(doc_id: Column, seed: str, buckets: int = BUCKETS) -> Column:
    """A bucket that the seed and the id alone decide, so that reruns agree."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "utf-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: float = 3.0) -> DataFrame:
    """(source, source_size) -> also target, by water-filling.

    Sources in code-point order, null last, weigh cycle, repeating. Where a source's share is above epochs times its
    size it stops there, and the rest is shared by weight among the others until none is above. The level that
    results is found in one pass: in order of cap/weight the sources that stop are a prefix, so running sums give
    the level after each prefix. The windows have no key: they run over one row a source.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.select("source", F.col("source_size").cast("long").alias("source_size"))
    w = w.withColumn("place", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    w = w.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy()
    w = w.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole),
    })
    w = w.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    w = w.withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("stops"), F.struct("cap_before", F.col("level")))).over(whole)["level"]
    return w.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(free * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """(row, size, source_size, target, whole, part): each document, as a struct of its columns, is taken whole times, and then part of its words once more.

    Every document of a source gets the same whole repetitions. The fraction that remains goes to buckets in order of
    the seeded hash: those below the boundary give all their words once more, the boundary's documents the fraction
    that still lacks, so a source's taken words miss its target by less than a word for each boundary document.
    Only sums by source and bucket are shuffled. A null text has size 0, a null source is a source, and rows with
    the same id are taken alike; an empty table gives an empty result; other columns may have any names.
    """
    sized = docs.select(F.struct(*all_columns(docs)).alias("row"), "source", word_count(F.col("text")).alias("size"), seeded_bucket(F.col("doc_id"), seed).alias("bucket"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, epochs)
    per = goal.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = per.withColumn("whole", F.floor("ratio").cast("long"))
    per = per.withColumn("rest", (F.col("ratio") - F.col("whole")) * F.col("source_size"))
    s = sums.select(F.col("source").alias("s"), "bucket", "words")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = per.join(s, per.source.eqNullSafe(s.s)).withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
    boundary = (F.col("words") > 0) & (F.col("below") + F.col("words") > F.col("rest"))
    edge = steps.groupBy("source").agg(F.min(F.when(boundary, F.struct("bucket", ((F.col("rest") - F.col("below")) / F.col("words")).alias("share")))).alias("edge"))
    e = edge.select(F.col("source").alias("s"), "edge")
    plan = per.join(e, per.source.eqNullSafe(e.s), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "edge")
    plan = stage(plan, "mix")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    part = (
        F.when(F.col("edge").isNull() | (F.col("bucket") > F.col("edge.bucket")), F.lit(0))
        .when(F.col("bucket") < F.col("edge.bucket"), F.col("size"))
        .otherwise(F.bround(F.col("size") * F.col("edge.share"), 0))
        .cast("long")
    )
    return sized.join(plan, sized.source.eqNullSafe(plan["of"])).select("row", "size", "source_size", "target", "whole", part.alias("part"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last repetition cut after its part of the words; the columns of docs.

    Documents without words aren't taken. n_chars, where docs has it, is counted anew for cut texts.
    """
    m = mix_sources(docs, **how)
    times = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    m = m.filter((times > 0) & (F.col("size") > 0)).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    cut = (F.col("turn") > F.col("whole")) & (F.col("part") < F.col("size"))
    words = F.split(F.regexp_replace("row.text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("part").cast("int")), "")).otherwise(F.col("row.text"))
    m = m.withColumn("text", text)
    made = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return m.select(*[(made[c] if c in made else F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])
