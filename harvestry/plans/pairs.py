"""Pairs of skills that jobs ask for together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Skills in a block, and from how many blocks on a job's pairs of blocks are dealt to other tasks.
BLOCK, MANY = 64, 8


def skill_pairs(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """(skill, co_skill, role_category, n): in how many of jobs a skill with a smaller id and one with a larger occur, by their names.

    A job's skills come together as one array, by name with the least and greatest id (names are mostly unique, then
    these are one). Blocks of the array meet each other within the row, and counts are added up before the only other
    shuffle; links are never joined to themselves. A job with very many skills is dealt out by pairs of blocks.
    """
    links = job_skills.join(jobs.select(F.col("id").alias("job_id"), "role_category"), "job_id").join(skills.select(F.col("id").alias("skill_id"), "name"), "skill_id")
    named = links.groupBy("job_id", "role_category", "name").agg(F.min("skill_id").alias("low"), F.max("skill_id").alias("high"))
    lists = named.groupBy("job_id", "role_category").agg(F.collect_list(F.struct("name", "low", "high")).alias("all"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / block).cast("int")), lambda k: F.slice("all", k * block + 1, block))
    lists = lists.select("role_category", blocks.alias("blocks"))

    def met(x: Column) -> Column:
        with_x = lambda a: F.transform(F.filter(F.col("right"), lambda b: a["low"] < b["high"]), lambda b: F.struct(a["name"].alias("skill"), b["name"].alias("co_skill")))
        return F.flatten(F.transform(x, with_x))

    one = lists.select("role_category", "blocks", F.explode("blocks").alias("left"))
    both = one.select("role_category", "left", F.explode("blocks").alias("right"), F.size("blocks").alias("size"))
    few, long = both.filter(F.col("size") < many), both.filter(F.col("size") >= many).repartition(F.xxhash64("left", "right"))
    pairs = few.unionByName(long).select("role_category", F.explode(met(F.col("left"))).alias("pair"))
    return pairs.groupBy("pair.skill", "pair.co_skill", "role_category").agg(F.count("*").alias("n"))
