"""Keyed writes as changes of DataFrames; versions.py publishes them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import numbered
from .versions import Merge, Store

__all__ = ["Merge", "Store"]


def one_row(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the first by order, if df has it, and else by a hash of all columns, so the same one always."""
    by = [F.col(order).asc_nulls_last()] if order in df.columns else []
    n = F.row_number().over(Window.partitionBy(key).orderBy(*by, F.xxhash64(*df.columns)))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def upsert_jobs(old: DataFrame, new: DataFrame, now: Column, preserve: tuple[str, ...] = ()) -> DataFrame:
    """Insert, or overwrite every supplied column, nulls too (but for preserve, where a null keeps the old value).

    Of rows that repeat an id the first by batch_pos counts, without that column the one with the smallest hash. Both sides shuffle once on id. Rows of new become active and seen now; first_seen_at and ingested_at stay.
    """
    o, n = old.alias("o"), one_row(new, "id", "batch_pos").alias("n")
    supplied, there = F.col("n.id").isNotNull(), F.col("o.id").isNotNull()
    out = []
    for c in old.columns:
        if c == "id":
            v = F.coalesce("n.id", "o.id")
        elif c in ("first_seen_at", "ingested_at"):
            v = F.when(there, F.col(f"o.{c}")).otherwise(now)
        elif c == "last_seen_at":
            v = F.when(supplied, now).otherwise(F.col(f"o.{c}"))
        elif c == "is_active":
            v = F.when(supplied, True).otherwise(F.col(f"o.{c}"))
        elif c not in new.columns:
            v = F.col(f"o.{c}")
        elif c in preserve:
            v = F.coalesce(f"n.{c}", f"o.{c}")
        else:
            v = F.when(supplied, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(v.cast(old.schema[c].dataType).alias(c))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(*out)


def upsert_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those with their key; the last by all columns where new repeats a key."""
    rest = [c for c in old.columns if c not in key]
    new = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, "r.*")
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def upsert_skills(old: DataFrame, found: DataFrame, overwrite: bool = True) -> DataFrame:
    """Skills by name: new names get the next ids in order of name, without a gap; a known name's category is overwritten, or stays."""
    new = found.groupBy("name").agg(F.min("category").alias("category"))
    kept = old.alias("o").join(new.alias("n"), "name", "left").select("o.id", "name", (F.coalesce("n.category", "o.category") if overwrite else F.col("o.category")).alias("category"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(new.join(old, "name", "left_anti"), "name", top + 1)
    return kept.unionByName(added.select("id", "name", "category"))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks."""
    return old.unionByName(new.select(*old.columns).dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def deactivate(jobs: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Jobs posted more than so many days ago become inactive; undated ones stay."""
    return jobs.withColumn("is_active", F.col("is_active") & ~F.coalesce(F.col("posted_at") < as_of - F.make_dt_interval(F.lit(days)), F.lit(False)))


def soft_delete(jobs: DataFrame, phrases: list[str]) -> DataFrame:
    """Jobs whose title holds a phrase become inactive."""
    t = F.lower("title")
    return jobs.withColumn("is_active", F.col("is_active") & ~F.coalesce(F.array_contains(F.array(*[t.contains(p.lower()) for p in phrases]), True), F.lit(False)))


def update_values(jobs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """One column set from (id, column); a null in values is a value."""
    v = one_row(values.select("id", column), "id").select(F.col("id"), F.col(column).alias("__new"), F.lit(True).alias("__set"))
    return jobs.join(v, "id", "left").withColumn(column, F.when(F.col("__set"), F.col("__new")).otherwise(F.col(column))).select(*jobs.columns)


def relink(links: DataFrame, skills: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and skills after aliases (alias, canonical) gave way: their links go to the canonical skill, then their rows go."""
    a = aliases.join(skills.select(F.col("name").alias("alias"), F.col("id").alias("from")), "alias").join(skills.select(F.col("name").alias("canonical"), F.col("id").alias("to")), "canonical").select("from", "to")
    moved = links.join(a, links.skill_id == a["from"], "left").select("job_id", F.coalesce("to", "skill_id").alias("skill_id")).distinct()
    return moved, skills.join(a, skills.id == a["from"], "left_anti")


def spellings(skills: DataFrame, canonical: str, lower: list[str], exact: list[str] = ()) -> DataFrame:
    """(alias, canonical): the names of skills that are other spellings of canonical, by lower case or exactly; names that join two with a slash are none."""
    name = F.col("name")
    where = (name != canonical) & (F.lower(name).isin(lower) | name.isin(list(exact))) & ~name.like("% / %")
    return skills.filter(where).select(name.alias("alias"), F.lit(canonical).alias("canonical")).distinct()


def write_summary(path: str, summary: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=2, default=str)


def read_summary(path: str) -> dict:
    """A run's summary; a failed one where the file lacks or isn't JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        return {"status": "failed", "error": str(e)}
