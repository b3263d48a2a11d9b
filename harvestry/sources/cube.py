"""Statistical cubes in SDMX-JSON: a sparse map from flat, row-major index to value; fetched as a Python data source."""

from __future__ import annotations

import json
import time
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .adverts import fetch

CUBE = "id array<string>, size array<int>, value map<string,double>, dimension map<string,struct<category:struct<index:map<string,int>>>>"


def unravel(cube: DataFrame, geo: str = "geo", time: str = "time", extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra, country_code, year, value) of cubes (a CUBE row each): coordinate = floor(index / product of the later sizes) mod size.

    Null values are left out; places are in lower case. Maps explode and invert on executors, nothing is looped over.
    """
    stride = F.transform(F.sequence(F.lit(1), F.size("size")), lambda i: F.aggregate(F.slice("size", i + 1, F.size("size")), F.lit(1), lambda a, b: a * b))
    cells = cube.withColumn("cube", F.monotonically_increasing_id()).withColumn("stride", stride)
    cells = cells.select(*extra, "cube", "id", "size", "stride", "dimension", F.explode("value").alias("flat", "v")).filter("v is not null")

    def label(dim: str):
        k = F.array_position("id", dim).cast("int")
        place = F.floor(F.col("flat").cast("long") / F.get("stride", k - 1)) % F.get("size", k - 1)
        inverse = F.map_from_entries(F.transform(F.map_entries(F.element_at("dimension", dim)["category"]["index"]), lambda e: F.struct(e["value"], e["key"])))
        return F.try_element_at(inverse, place.cast("int"))

    return cells.select(*extra, F.lower(label(geo)).alias("country_code"), label(time).try_cast("smallint").alias("year"), F.col("v").alias("value"))


def context(cube: DataFrame, known: list[str], indicator: str, since: int = 2019) -> DataFrame:
    """Rows of the context table from cubes: known countries, from a year on, two decimals."""
    u = unravel(cube).filter(F.col("country_code").isin(known) & (F.col("year") >= since))
    return u.select("country_code", "year", F.lit(indicator).alias("indicator"), F.round("value", 2).cast("decimal(5,2)").alias("value"))


class RestCubes(DataSource):
    """format("cubes"): options of the form indicator.<name> = url, waits, timeout; a partition a cube. A cube that can't be had is an error, not a gap."""

    @classmethod
    def name(cls) -> str:
        return "cubes"

    def schema(self) -> str:
        return "indicator string, cube string"

    def reader(self, schema):
        return _Cubes(self.options)


class _Cubes(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = {k.split(".", 1)[1]: v for k, v in options.items() if k.startswith("indicator.")}
        self.timeout, self.waits = float(options.get("timeout", 30)), tuple(float(w) for w in options.get("waits", "2,4").split(","))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in sorted(self.urls.items())]

    def read(self, partition: InputPartition):
        indicator, url = partition.value
        got = fetch(lambda u: urllib.request.urlopen(u, timeout=self.timeout).read(), url, time.sleep, self.waits)  # noqa: S310
        if got is None:
            raise OSError(f"{indicator}: {url}")
        yield indicator, json.dumps(got)


def contexts(cubes: DataFrame, known: list[str], since: int = 2019) -> DataFrame:
    """Rows of RestCubes as rows of the context table: known countries, from a year on, two decimals."""
    c = cubes.select("indicator", F.from_json("cube", CUBE).alias("c")).select("indicator", "c.*")
    u = unravel(c, extra=("indicator",)).filter(F.col("country_code").isin(known) & (F.col("year") >= since))
    return u.select("country_code", "year", "indicator", F.round("value", 2).cast("decimal(5,2)").alias("value"))
