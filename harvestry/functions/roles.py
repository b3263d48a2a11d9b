"""Roles by ordered phrases and skills by longest match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import skills
from .catalog import DEFAULT, Catalog


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    return c.rlike("|".join(rf"\Q{p}\E" for p in phrases)) if phrases else F.lit(False)


def role(title: Column, text: Column, catalog: Catalog = DEFAULT) -> Column:
    """Null without a title or for work outside IT; else the first role with a phrase in the title, then in the text; else other.

    Phrases are plain substrings of the lower-case title (its underscores as spaces) or text.
    """
    t, d = F.translate(F.lower(title), "_", " "), F.lower(F.coalesce(text, F.lit("")))
    out = F.when(title.isNull() | (F.trim(title) == "") | _any(t, catalog.outside), F.lit(None).cast("string"))
    for name, phrases in catalog.titles.items():
        out = out.when(_any(t, phrases), name)
    for name, phrases in catalog.texts.items():
        out = out.when(_any(d, phrases), name)
    return out.otherwise("other")


def skills_of(text: str | None, compiled: list[tuple[str, str, list[re.Pattern]]]) -> list[tuple[str, str]]:
    """Each skill's first match by its first matching pattern; longest first, catalog order among equals; none that overlaps a longer one."""
    found = []
    for k, (name, kind, patterns) in enumerate(compiled):
        m = next((m for p in patterns if (m := p.search(text or ""))), None)
        if m:
            found.append((m.start() - m.end(), k, m.start(), m.end(), name, kind))
    taken: list[tuple[int, int]] = []
    out = []
    for _, _, a, b, name, kind in sorted(found):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((name, kind))
    return out


def skills_native(text: Column, catalog: Catalog = DEFAULT) -> Column:
    """As skills(), without Python: matches as structs, sorted, accepted one after the other."""
    one = []
    for k, (name, kind, patterns) in enumerate(catalog.skills):
        match = F.coalesce(*[F.when(F.regexp_instr(text, F.lit(f"(?iU){p}")) > 0, F.struct(F.regexp_instr(text, F.lit(f"(?iU){p}")).alias("at"), F.length(F.regexp_extract(text, f"(?iU){p}", 0)).alias("size"))) for p in patterns])
        one.append(F.struct((-match["size"]).alias("short"), F.lit(k).alias("ord"), match["at"].alias("a"), (match["at"] + match["size"]).alias("b"), F.lit(name).alias("skill"), F.lit(kind).alias("category")))
    found = F.array_sort(F.filter(F.array(*one), lambda x: x["a"].isNotNull()))
    start = F.array().cast("array<struct<short:int,ord:int,a:int,b:int,skill:string,category:string>>")
    kept = F.aggregate(found, start, lambda acc, x: F.when(F.exists(acc, lambda y: (x["a"] < y["b"]) & (y["a"] < x["b"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: F.struct(x["skill"].alias("skill"), x["category"].alias("category")))


def canonical_skill(raw: Column, catalog: Catalog = DEFAULT) -> Column:
    """struct(name, category) of a skill as a classifier names it, or null: a catalog name, else the first pattern's skill, else short words with a letter as a tool."""
    t = F.trim(raw)
    words = F.size(F.split(t, r"\s+"))
    out = F.when(t.isNull() | (F.length(t) < 2) | (F.length(t) > 80) | (words > 5), F.lit(None))
    pair = lambda n, k: F.struct(F.lit(n).alias("name"), F.lit(k).alias("category"))
    for n, k, _ in catalog.skills:
        out = out.when(F.lower(t) == n.lower(), pair(n, k))
    for n, k, patterns in catalog.skills:
        out = out.when(t.rlike("(?iU)" + "|".join(patterns)), pair(n, k))
    return out.when(t.rlike("[A-Za-z]") & (words <= 4), F.struct(t.alias("name"), F.lit("tool").alias("category")))


def job_skills(jobs: DataFrame, text: Column, catalog: Catalog = DEFAULT) -> DataFrame:
    """(job_id, skill_name, skill_category), a row a skill."""
    return jobs.select(F.col("id").alias("job_id"), F.explode(skills(text, catalog)).alias("s")).select("job_id", F.col("s.skill").alias("skill_name"), F.col("s.category").alias("skill_category"))
