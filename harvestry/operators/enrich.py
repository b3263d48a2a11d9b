"""Enrichment by an external classifier: candidates, a ledger of what is done, the call, and the policy that merges its answers."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.catalog import DEFAULT, Catalog
from ..functions.roles import canonical_skill
from ..schema import ROLES
from .store import insert_ignore, upsert_skills

#: Seconds that a request for one job and one for a batch may take.
ONE_TIMEOUT, BATCH_TIMEOUT = 15, 120
ANSWER = "id bigint, role_category string, skills array<string>, is_tech boolean, answered boolean"


def backlog(jobs: DataFrame, as_of: Column, country: str | None = None, days: int | None = None, limit: int | None = None) -> DataFrame:
    """Jobs that still lack a full text and can be crawled, newest first: active, with a url that is no redirect page; of a country, of the last days, so many."""
    where = F.col("is_active") & F.col("url").isNotNull() & F.nullif("description_full", F.lit("")).isNull() & ~F.col("url").contains("/land/")
    if country is not None:
        where = where & (F.col("country_code") == country)
    if days is not None:
        where = where & (F.col("posted_at") >= as_of - F.make_dt_interval(F.lit(days)))
    out = jobs.filter(where).orderBy(F.col("posted_at").desc_nulls_first(), "id")
    return out if limit is None else out.limit(limit)


def candidates(jobs: DataFrame, as_of: Column, mode: str = "gaps", days: int | None = None, inactive: bool = False) -> DataFrame:
    """Jobs to classify: all, or those without a role or with other; ingested in the last days; active unless inactive."""
    where = F.lit(True)
    if mode != "all":
        where = where & (F.col("role_category").isNull() | (F.col("role_category") == "other"))
    if days is not None:
        where = where & (F.col("ingested_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return jobs.filter(where if inactive else where & F.col("is_active"))


def pending(jobs: DataFrame, ledger: DataFrame, model: str) -> DataFrame:
    """Candidates with text, text_source and input_hash that the ledger hasn't as processed."""
    t = jobs.withColumn("s", text.selected(F.col("description_full"), F.col("description_short"))).select("*", "s.text", "s.text_source").drop("s")
    t = t.withColumn("input_hash", text.content_hash(F.col("title"), F.col("text_source"), F.lit(model), F.col("text")))
    done = ledger.filter((F.col("status") == "processed") & (F.col("model") == model)).select(F.col("job_id").alias("id"), "input_hash")
    return t.join(done, ["id", "input_hash"], "left_anti")


def results(reply: str | None) -> list[dict]:
    """The answers in a classifier's reply: the list ``results`` of its first JSON object, else the object's members that are objects (numbered keys); none if there is no such object."""
    for part in (reply or "", (re.search(r"\{.*\}", reply or "", re.S) or [""])[0]):
        try:
            got = json.loads(part)
        except ValueError:
            continue
        if isinstance(got, dict):
            items = got.get("results") or [v for v in got.values() if isinstance(v, dict)]
            return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    return []


def http_post(url: str, timeout: float = BATCH_TIMEOUT) -> Callable[[dict], str]:
    """post(request) -> the reply's text, for llm_classifier(), from a server that takes and returns JSON; OSError or ValueError where it doesn't answer in time or not so."""

    def post(request: dict) -> str:
        body = urllib.request.Request(url, json.dumps(request).encode(), {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(body, timeout=timeout) as r:  # noqa: S310
            return json.loads(r.read())["response"]

    return post


def llm_classifier(post: Callable[[dict], str], model: str, roles: list[str]) -> Callable[[list[dict]], list[dict]]:
    """A classifier for classify() that asks a language model: post takes the request and returns the reply's text."""

    def ask(rows: list[dict]) -> list[dict]:
        texts = "\n".join(f"{k + 1}. {r['title']}: {r['text']}" for k, r in enumerate(rows))
        prompt = f"For each numbered job give role_category (one of {', '.join(roles)}), skills and is_tech, as JSON {{\"results\": [...]}}.\n{texts}"
        return results(post({"model": model, "prompt": prompt, "format": "json", "stream": False, "options": {"temperature": 0}}))

    return ask


def classify(rows: DataFrame, classifier: Callable[[list[dict]], list[dict]], batch: int = 10) -> DataFrame:
    """Answers by id. classifier takes up to batch rows (id, title, text) and returns dicts, the surplus of which goes.

    Where it fails or gives too few, the rest has no role, no skills and counts as IT work, so a bad batch ends no task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                try:
                    got = list(classifier(part.to_dict("records")))[: len(part)]
                except Exception:
                    got = []
                none = [False] * (len(part) - len(got))
                answered = [True] * len(got) + none
                got += [{} for _ in none]
                yield pd.DataFrame({
                    "id": part["id"].values, "role_category": [g.get("role_category") for g in got], "skills": [[s for s in g.get("skills") or [] if isinstance(s, str)] for g in got],
                    "is_tech": [g.get("is_tech") not in (False, 0, "false", "0", "no") for g in got], "answered": answered,
                })

    raw = rows.select("id", "title", "text").mapInPandas(run, ANSWER)
    made = text.classifier_result(F.col("role_category"), F.col("skills"), F.col("is_tech"), ROLES)
    return raw.select("id", "answered", made.alias("r")).select("id", F.when(F.col("answered"), F.col("r.role_category")).alias("role_category"), "r.skills", "r.is_tech")


def merge_role(before: Column, proposal: Column, is_tech: Column, everything: bool = False, update: bool = False) -> Column:
    """struct(write, role): whether and what to write, by whether the job is IT work and what is known of it."""
    open_role = before.isNull() | (before == "other")
    valid = F.coalesce(proposal.isin(ROLES), F.lit(False))
    better = valid & ((proposal != "other") | F.lit(everything))
    write = F.when(~is_tech, open_role).when(open_role, better).otherwise(better & F.lit(update))
    return F.struct(write.alias("write"), F.when(write & is_tech, proposal).when(write, F.lit(None)).otherwise(before).alias("role"))


def ledger_put(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The latest row of each (job, hash, model)."""
    last = Window.partitionBy("job_id", "input_hash", "model").orderBy(F.col("reviewed_at").desc_nulls_last(), F.xxhash64(*ledger.columns))
    return ledger.unionByName(rows.select(*ledger.columns)).withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")


def resolve_ids(names: DataFrame, skills: DataFrame) -> DataFrame:
    """(name, id): by the exact name, else without case; of several rows then the one spelt as canonical (a column that names may have), else the smallest id."""
    names = names if "canonical" in names.columns else names.withColumn("canonical", F.col("name"))
    exact = names.join(skills.select("name", "id"), "name")
    rest = names.join(skills, "name", "left_anti").join(skills.select(F.lower("name").alias("low"), F.col("name").alias("spelt"), "id"), F.lower("name") == F.col("low"))
    best = rest.groupBy("name").agg(F.min(F.struct(F.col("spelt") != F.col("canonical"), "id")).alias("b")).select("name", "b.id")
    return exact.groupBy("name").agg(F.min("id").alias("id")).unionByName(best)


def add_skills(skills: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skills, links) with found (job_id, name, category): new names are added once whatever their case, known ones keep their category, and links are only added."""
    known = skills.select(F.lower("name").alias("low"))
    one = found.filter("name is not null").groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("name", "category")).alias("r"))
    after = upsert_skills(skills, one.join(known, "low", "left_anti").select("r.name", "r.category"), overwrite=False)
    ids = resolve_ids(found.select("name").filter("name is not null").distinct(), after)
    new = found.join(ids, "name").select("job_id", F.col("id").alias("skill_id")).distinct()
    return after, insert_ignore(links, new, ["job_id", "skill_id"])


def new_skills(answers: DataFrame, jobs: DataFrame, links: DataFrame, skills: DataFrame, catalog: Catalog = DEFAULT) -> DataFrame:
    """(job_id, name, category): what answers (id, skills, is_tech) name that their jobs lack, canonical and once whatever the case; nothing for jobs outside IT."""
    said = answers.filter("is_tech").join(jobs.select("id"), "id", "left_semi").select(F.col("id").alias("job_id"), F.explode("skills").alias("raw"))
    said = said.withColumn("c", canonical_skill(F.col("raw"), catalog)).filter("c is not null").select("job_id", F.lower("c.name").alias("low"), "c.name", "c.category")
    has = links.join(skills.select(F.col("id").alias("skill_id"), F.lower("name").alias("low")), "skill_id").select("job_id", "low")
    return said.join(has, ["job_id", "low"], "left_anti").groupBy("job_id", "low").agg(F.min(F.struct("name", "category")).alias("r")).select("job_id", "r.name", "r.category")
