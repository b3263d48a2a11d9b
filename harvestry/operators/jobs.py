"""Raw adverts to jobs: flatten, validate, derive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pay, text
from ..functions.catalog import DEFAULT, Catalog
from ..functions.roles import job_skills, role


def flatten(raw: DataFrame) -> DataFrame:
    """Nested adverts (with country_code) as flat rows; those without an id go. Missing members are null by the schema."""
    low, high = pay.euros(F.col("country_code"), F.col("salary_min"), F.col("salary_max"))
    return raw.filter("id is not null").select(
        F.col("id").try_cast("bigint").alias("id"), "title", F.col("company.display_name").alias("company"), F.col("location.display_name").alias("location_display"),
        F.try_element_at("location.area", F.lit(-1)).alias("city"), "country_code", low.alias("salary_min"), high.alias("salary_max"), (F.coalesce("salary_is_predicted", F.lit("0")) == "1").alias("salary_is_predicted"),
        "contract_type", "contract_time", F.col("description").alias("description_short"), F.lit(None).cast("string").alias("description_full"), F.col("redirect_url").alias("url"), F.try_to_timestamp("created").alias("posted_at"), F.monotonically_increasing_id().alias("batch_pos"),
    )


def validate(flat: DataFrame, countries: list[str], order: str = "batch_pos") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason): bad id, then bad title, then unknown country, then all but an id's first row by order (rows alike in it by a hash).

    flatten() numbers the batch's rows in batch_pos; it is gone from what is valid.
    """
    for name in ("title", "company", "location_display", "city"):
        flat = flat.withColumn(name, text.cut(text.normal(F.col(name)), text.LIMITS[name]))
    reason = F.when(F.coalesce("id", F.lit(0)) == 0, "id").when(F.col("title").isNull(), "title").when(~F.coalesce(F.col("country_code").isin(countries), F.lit(False)), "country")
    flat = flat.withColumn("reason", reason)
    row = F.row_number().over(Window.partitionBy("id", F.col("reason").isNull()).orderBy(F.col(order).asc_nulls_last(), F.xxhash64(*flat.columns)))
    flat = flat.withColumn("reason", F.coalesce("reason", F.when(row > 1, "duplicate")))
    return flat.filter("reason is null").drop("reason", "batch_pos"), flat.filter("reason is not null")


def derive(valid: DataFrame, catalog: Catalog = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(jobs, job_skills): contract fields, pay's middle, clean text, remote, role; and a row for each skill found."""
    jobs = valid.withColumns({
        "contract_type": text.contract_type(F.col("contract_type")), "contract_time": text.contract_time(F.col("contract_time")), "salary_mid": pay.middle(F.col("salary_min"), F.col("salary_max")),
        "clean": text.clean_lines(F.coalesce(F.nullif("description_full", F.lit("")), "description_short")),
    }).withColumns({"remote": text.remote(F.col("title"), F.col("clean"), F.col("location_display")), "role_category": role(F.col("title"), F.col("clean"), catalog)})
    return jobs.drop("clean"), job_skills(jobs, F.concat_ws(" ", "title", "clean"), catalog)
