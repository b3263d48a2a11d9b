"""Versions of tables: a publication writes the files it changes and a manifest, and then switches one pointer, so a failed load changes nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key columns of each table; files are sorted by the first, and a row is known by all of them.
KEYS = {"jobs": ("id",), "skills": ("id",), "job_skills": ("job_id", "skill_id"), "ledger": ("job_id", "input_hash", "model")}
ROWS_PER_FILE = 1_000_000


@dataclass(frozen=True)
class File:
    """A data file under the store's folder, with the least and greatest key in it."""

    path: str
    low: int
    high: int
    rows: int


@dataclass(frozen=True)
class Merge:
    """A change of some rows of a table: ids, (key) of all rows that may change or come, and what the files that can hold them shall hold, from what they hold."""

    ids: DataFrame
    combine: Callable[[DataFrame], DataFrame]


def slots(files: list[File]) -> list[list[File]]:
    """Files in order of their keys; those whose ranges overlap are one slot."""
    out: list[list[File]] = []
    for f in sorted(files, key=lambda f: (f.low, f.high)):
        if out and f.low <= max(x.high for x in out[-1]):
            out[-1].append(f)
        else:
            out.append([f])
    return out


def placed(key: Column, lows: list[int], highs: list[int] | None = None, parts: list[int] | None = None) -> Column:
    """The slot whose range holds or precedes a key, by binary search; with parts, slot << 20 and which of its parts, by the key's place in the range."""
    a, b = np.array(lows[1:], np.int64), None if highs is None else np.array(highs, np.float64)
    low, k = np.array(lows, np.float64), None if parts is None else np.array(parts, np.int64)

    @F.pandas_udf("long")
    def at(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            slot = np.searchsorted(a, s.to_numpy(np.int64), "right")
            if k is None:
                yield pd.Series(slot)
                continue
            share = (s.to_numpy(np.float64) - low[slot]) / (b[slot] - low[slot] + 1)
            yield pd.Series((slot << 20) + np.clip((share * k[slot]).astype(np.int64), 0, k[slot] - 1))

    return at(key.cast("long"))


def differing(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after) of rows that are on one side alone or differ, from (keys, before) and (keys, after) with structs."""
    return before.join(after, keys, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


class Store:
    """A folder of versions; of the files CURRENT-<n> the highest names the one that readers see.

    A version is a folder with a manifest: for each table its schema and its files, each with its range of keys. Files
    are shared by versions, so a publication writes those that it changes. Tables with keys are sorted by ranges: a
    merge() rewrites only files whose range holds a key that may change, and a file that outgrows rows_per_file is split.

    A pointer is written aside and renamed to a name that no file has, so at no time is there none: a crash between
    any two steps leaves the version before, and files that the next publication's clean-up removes. Of two publishers
    one fails, where the file system's rename doesn't overwrite (local folders, HDFS); in an object store without such
    a rename let one process publish.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3, rows_per_file: int = ROWS_PER_FILE, keys: dict[str, tuple[str, ...]] | None = None) -> None:
        """keep versions stay when a newer one is published, for readers that still use them and for changes() since them."""
        self.spark, self.root, self.keep, self.rows_per_file, self.keys = spark, root.rstrip("/"), max(1, keep), rows_per_file, KEYS if keys is None else keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[8:]) for n in names if n.startswith("CURRENT-") and n[8:].isdigit())

    def _lines(self, name: str) -> list[str]:
        return [r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect()]

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()

    def _pointer(self, n: int) -> tuple[str, str]:
        """A pointer's version and publication key."""
        lines = self._lines(f"CURRENT-{n}")
        return lines[0], lines[1] if len(lines) > 1 else ""

    def version(self) -> str | None:
        n = self._pointers()
        return self._pointer(n[-1])[0] if n else None

    def versions(self) -> list[str]:
        """Those that are kept, oldest first."""
        return [self._pointer(n)[0] for n in self._pointers()]

    def published(self, key: str) -> bool:
        """Whether a kept version was published under this key."""
        return any(self._pointer(n)[1] == key for n in self._pointers())

    def manifest(self, version: str | None = None) -> dict:
        """table -> (schema as JSON, files) of a version, the current one if none is given; what was noted beside them under ''."""
        version = version or self.version()
        if version is None:
            return {"": {}}
        out, note = {}, {}
        for line in self._lines(f"{version}/manifest"):
            x = json.loads(line)
            if "note" in x:
                note = x["note"]
            elif "schema" in x:
                out[x["table"]] = (x["schema"], [])
            else:
                out[x["table"]][1].append(File(*x["file"]))
        return out | {"": note}

    def _rows(self, schema: str, files: list[File]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        paths = [f"{self.root}/{f.path}" for f in files]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, table: str, version: str | None = None) -> DataFrame | None:
        found = self.manifest(version).get(table)
        return self._rows(*found) if found else None

    def _touched(self, files: list[File], ids: DataFrame) -> tuple[list[list[File]], dict[int, tuple[int, int, int]]]:
        """All slots, and of those that hold an id: how many ids, the least and the greatest. One row a slot comes to the driver."""
        all_slots = slots(files)
        key = ids.columns[0]
        at = placed(F.col(key), [s[0].low for s in all_slots]) if all_slots else F.lit(0)
        rows = ids.groupBy(at.alias("slot")).agg(F.count("*"), F.min(key), F.max(key)).collect()
        return all_slots, {r[0]: (r[1], r[2], r[3]) for r in rows}

    def lookup(self, table: str, ids: DataFrame, version: str | None = None) -> DataFrame | None:
        """The rows of a table whose first key is in ids (one column, named as the key): only files whose range holds one of them are read."""
        found = self.manifest(version).get(table)
        if not found:
            return None
        ids = ids.dropna().distinct()
        all_slots, touched = self._touched(found[1], ids)
        return self._rows(found[0], [f for k in sorted(touched) if k < len(all_slots) for f in all_slots[k]]).join(ids, ids.columns[0], "left_semi")

    def page(self, table: str, after: int, size: int, where: Column | None = None) -> DataFrame | None:
        """The first size rows by key whose key is greater than after, and that meet where: files are read from there on, twice as many each time, until they suffice."""
        found = self.manifest().get(table)
        if not found:
            return None
        key = self.keys[table][0]
        ahead = sorted((f for f in found[1] if f.high > after), key=lambda f: (f.low, f.high))
        take, rows = 1, 0
        while True:
            while take < len(ahead) and sum(f.rows for f in ahead[1:take]) < size:
                take += 1
            chosen = ahead[:take]
            while take < len(ahead) and ahead[take].low <= max(f.high for f in chosen):  # equal keys go on there
                take += 1
                chosen = ahead[:take]
            out = self._rows(found[0], chosen).filter(F.col(key) > after)
            out = out if where is None else out.filter(where)
            rows = out.limit(size).count() if where is not None and take < len(ahead) else size
            if rows >= size or take >= len(ahead):
                return out.orderBy(*self.keys[table]).limit(size)
            take *= 2

    def _written(self, table: str, folder: str) -> list[File]:
        """The files of a new folder with rows, and their keys' ranges."""
        df = self.spark.read.parquet(f"{self.root}/{folder}") if self._any(f"{self.root}/{folder}") else None
        if df is None:
            return []
        key = F.col(self.keys[table][0]).cast("long") if table in self.keys else F.lit(0).cast("long")
        rows = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key), F.max(key), F.count("*")).collect()
        inside = lambda p: f"{folder}/" + p.split(f"/{folder}/", 1)[1]
        return [File(inside(r[0]), -(2**63) if r[1] is None else r[1], 2**63 - 1 if r[2] is None else r[2], r[3]) for r in sorted(rows)]

    def _any(self, path: str) -> bool:
        found = self._fs.listFiles(self._path(path), True)
        while found.hasNext():
            if found.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def _write(self, table: str, df: DataFrame) -> list[File]:
        folder = f"d-{uuid.uuid4().hex}/{table}"
        keys = self.keys.get(table)
        if keys and set(keys) <= set(df.columns):
            df = df.repartitionByRange(keys[0]).sortWithinPartitions(*keys)
        df.write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.root}/{folder}")
        return self._written(table, folder)

    def _merge(self, table: str, schema: str, files: list[File], change: Merge) -> tuple[str, list[File]]:
        key = self.keys[table][0]
        all_slots, touched = self._touched(files, change.ids.dropna())
        if not touched:
            return schema, files
        mine = sorted(touched)
        old = [f for k in mine if k < len(all_slots) for f in all_slots[k]]
        new = change.combine(self._rows(schema, old))
        held = all_slots or [[]]
        low = [min([f.low for f in s] + ([touched[k][1]] if k in touched else [])) for k, s in enumerate(held)]
        high = [max([f.high for f in s] + ([touched[k][2]] if k in touched else [])) for k, s in enumerate(held)]
        parts = [-(-(sum(f.rows for f in s) + touched.get(k, (0,))[0]) // self.rows_per_file) or 1 for k, s in enumerate(held)]
        folder = f"d-{uuid.uuid4().hex}/{table}"
        at = placed(F.col(key), low, high, parts)
        new.withColumn("__part", at).repartition("__part").sortWithinPartitions("__part", *self.keys[table]).write.partitionBy("__part").parquet(f"{self.root}/{folder}")
        gone = {f.path for f in old}
        return new.schema.json(), [f for f in files if f.path not in gone] + self._written(table, folder)

    def publish(self, tables: dict[str, DataFrame | Merge], key: str = "", note: dict | None = None) -> str:
        """Write what changes, then a manifest, then its pointer; tables that aren't given stay as they are. OSError if another publication was faster.

        A Merge on a table that isn't there yet starts from no rows only if its combine() makes them from nothing: give whole tables first.
        """
        before, v = self._pointers(), f"v-{uuid.uuid4().hex}"
        n = before[-1] if before else 0
        now = self.manifest(self._pointer(n)[0]) if before else {"": {}}
        for name, df in tables.items():
            now[name] = self._merge(name, *now[name], df) if isinstance(df, Merge) else (df.schema.json(), self._write(name, df))
        lines = [json.dumps({"note": now.pop("") | (note or {})})]
        for name, (schema, files) in now.items():
            lines.append(json.dumps({"table": name, "schema": schema}))
            lines += [json.dumps({"table": name, "file": [f.path, f.low, f.high, f.rows]}) for f in files]
        self._put(f"{v}/manifest", "\n".join(lines) + "\n")
        self._put(f".next-{v}", f"{v}\n{key}\n")
        if not self._fs.rename(self._path(f"{self.root}/.next-{v}"), self._path(f"{self.root}/CURRENT-{n + 1}")):
            raise OSError(f"{self.root}/CURRENT-{n + 1} is there already")
        self._clean()
        return v

    def _clean(self) -> None:
        """Remove pointers beyond those kept, then what no kept version names and is older than the newest."""
        pointers = self._pointers()
        kept = {self._pointer(n)[0] for n in pointers[-self.keep :]}
        kept |= {f.path.split("/", 1)[0] for v in list(kept) for k, t in self.manifest(v).items() if k for f in t[1]}
        newest = self._fs.getFileStatus(self._path(f"{self.root}/CURRENT-{pointers[-1]}")).getModificationTime()
        for n in pointers[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/CURRENT-{n}"), False)
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith(("v-", "d-")) and name not in kept and f.getModificationTime() < newest:
                self._fs.delete(f.getPath(), True)

    def changes(self, table: str, since: str, version: str | None = None) -> DataFrame:
        """(keys, before, after): rows that differ between two kept versions, before or after as structs, null where there is no such row.

        Files that both versions name hold the same rows, so only the others are read: the cost follows the loads between them.
        """
        old, new = self.manifest(since).get(table), self.manifest(version).get(table)
        found = [(m[0], {f.path: f for f in m[1]}) if m else None for m in (old, new)]
        if not any(found):
            raise ValueError(f"no version has {table}")
        schema = (found[1] or found[0])[0]
        paths = [f[1] if f else {} for f in found]
        keys = list(self.keys[table])
        sides = []
        for k, name in enumerate(("before", "after")):
            rows = self._rows((found[k] or (schema,))[0], [f for p, f in paths[k].items() if p not in paths[1 - k]])
            columns = T.StructType.fromJson(json.loads(schema)).fields
            value = F.struct(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])
            sides.append(rows.select(*keys, value.alias(name)))
        return differing(*sides, keys)

    def size(self) -> int | None:
        """Bytes in the folder; None if it can't be read."""
        try:
            return self._fs.getContentSummary(self._path(self.root)).getLength()
        except Exception:
            return None

