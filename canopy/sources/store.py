"""Table store with atomic commits.

Data files are written first, into new folders ``<root>/<name>/<version>``.
One manifest then names the folders of every table: a file
``<root>/_manifests/<number>`` that is written under another name and renamed
to its number.  Where another writer took that number (HDFS then refuses the
rename; local disks, of one writer, are only checked before it), the commit is
made anew on top of the other's.  Readers use the largest number, so they see
all tables of one commit or none of it, and a crash leaves the commit before
it in place.  An append adds a folder to a table; a
merge never overwrites what it reads.

A table written by :meth:`TableStore.merge` is bucketed by a hash of its keys,
a folder a bucket.  A merge reads and writes the buckets of its rows alone; the
new manifest names the other buckets' folders as before.
The root is ``canopy.store.dir`` when set, else a folder inside the
cluster's shared ``spark.checkpoint.dir`` (never a machine-local path on a
cluster; tests get a scratch folder from :func:`canopy.session.checkpoint_dir`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.session import checkpoint_dir, materialize

COMMIT_TRIES = 20
BUCKETS = 64                # of a table's first merge; later ones keep its number
BUCKET = "canopy_bucket"    # folder column of bucketed tables


class Merge(NamedTuple):
    """Rows to merge into a bucketed table: ``combine(old rows of the touched buckets, rows)`` gives those buckets anew."""
    rows: DataFrame
    keys: tuple[str, ...]
    combine: Callable[[DataFrame, DataFrame], DataFrame]


class Stale(Exception):
    """Another commit changed a bucket that this merge has read."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @classmethod
    def for_session(cls, spark: SparkSession) -> "TableStore":
        root = spark.conf.get("canopy.store.dir", None)
        if not root:
            root = checkpoint_dir(spark).rstrip("/") + "/canopy-store"
        return cls(spark, root)

    # -- manifests

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifests/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        """(number, folders of each table) of the latest commit; number 0: none yet."""
        files, folder = self._files(), self._path("x").getParent()
        if not files.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        stream = files.open(self._path(f"{max(numbers):012d}"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, change: Callable[[dict[str, list[str]]], dict[str, list[str]]]) -> None:
        """Apply ``change`` to the latest manifest and publish the result; tried again if another commit came first."""
        files = self._files()
        for _ in range(COMMIT_TRIES):
            number, tables = self._manifest()
            staged, final = self._path(f"staged-{uuid.uuid4().hex}"), self._path(f"{number + 1:012d}")
            stream = files.create(staged, False)
            stream.write(bytearray(json.dumps(change(tables)).encode()))
            stream.close()
            if not files.exists(final) and files.rename(staged, final):
                return
            files.delete(staged, False)
        raise RuntimeError(f"no commit to {self.root} in {COMMIT_TRIES} tries")

    def _stage(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        v = "v-" + uuid.uuid4().hex
        w = df.write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{self.root}/{name}/{v}")
        return v

    # -- tables

    def version(self, name: str) -> str | None:
        """The folders of the table's latest commit, joined by commas."""
        folders = self._manifest()[1].get(name)
        return None if folders is None else ",".join(folders)

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def read(self, name: str) -> DataFrame:
        tables = self._manifest()[1]
        if name not in tables:
            raise KeyError(f"table {name} does not exist in {self.root}")
        if f"{name}/schema" in tables:
            return self._buckets(name, tables[name], _schema(tables[f"{name}/schema"]))
        parts = [self.spark.read.parquet(f"{self.root}/{name}/{f}") for f in tables[name]]  # each may have partition folders
        return reduce(lambda a, b: a.unionByName(b), parts)

    def _buckets(self, name: str, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{f}" for f in folders))

    def replace(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a new version, then commit it in place of the old one."""
        v = self._stage(name, df, partition_by)
        self._commit(lambda tables: {**_without(tables, name), name: [v]})
        return v

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Add rows in a folder of their own (cache tables: S8; index segments)."""
        v = self._stage(name, df, partition_by)
        self._commit(lambda tables: {**tables, name: [*tables.get(name, []), v]})

    def put_summaries(self, name: str, new: DataFrame) -> None:
        """One row per hash: new hashes are appended; where an error row is
        replaced, the table is written anew without it."""
        if not self.exists(name):
            self.replace(name, new)
            return
        old = self.read(name)
        if old.where("status <> 'ok'").isEmpty():
            self.append(name, new.join(old.select("hash"), "hash", "left_anti").select(*old.columns))
            return
        fresh = materialize(new, name)
        kept = old.where("status = 'ok'").join(fresh.select("hash"), "hash", "left_anti")
        left = old.where("status <> 'ok'").join(fresh.select("hash"), "hash", "left_anti")
        self.replace(name, kept.unionByName(left).unionByName(fresh))

    def upsert(self, name: str, new: DataFrame, keys=("id", "model"), order: str = "batch",
               partition_by: list[str] | None = ("model",)) -> str:
        """Latest-wins merge on ``keys`` written as a new version."""
        from canopy.operators.vectors import upsert_embeddings
        if self.exists(name):
            merged = upsert_embeddings(self.read(name), new, keys, order)
        else:
            merged = upsert_embeddings(new.limit(0), new, keys, order)
        return self.replace(name, merged, list(partition_by) if partition_by else None)

    def replace_many(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
        """Several tables staged first, then one commit for all of them."""
        staged = {name: self._stage(name, df, (partition_by or {}).get(name)) for name, df in tables.items()}
        self._commit(lambda old: {**_without(old, *staged), **{name: [v] for name, v in staged.items()}})
        return staged

    # -- bucketed tables

    def merge(self, name: str, rows: DataFrame, keys: tuple[str, ...], combine=None) -> list[int]:
        """Merge rows into a bucketed table, latest version of a key wins unless ``combine`` says otherwise; the touched buckets."""
        return self.merge_many({name: Merge(rows, tuple(keys), combine or _replacing(tuple(keys)))})[name]

    def merge_many(self, changes: dict[str, Merge], buckets: int = BUCKETS) -> dict[str, list[int]]:
        """Merge into several bucketed tables in one commit; buckets that no row touches keep their folders.

        The tables are made where they do not exist.  ``rows`` is read several
        times, so it should be a stored table or a cheap plan.  A merge whose
        buckets another commit has changed meanwhile is made anew.
        """
        for _ in range(COMMIT_TRIES):
            base, made, seen = self._manifest()[1], {}, {}
            for name, m in changes.items():
                if name in base and f"{name}/schema" not in base:
                    raise ValueError(f"table {name} is not bucketed")
                n = int(base.get(f"{name}/buckets", [buckets])[0])
                spot = F.pmod(F.xxhash64(*m.keys), F.lit(n)).cast("int")
                touched = sorted(r[0] for r in m.rows.select(spot).distinct().collect())  # at most the number of buckets
                own = _by_bucket(base.get(name, []))
                held = [own[b] for b in touched if b in own]
                schema = _schema(base[f"{name}/schema"]) if name in base else m.rows.schema
                new = m.combine(self._buckets(name, held, schema), m.rows)
                folder = self._stage(name, new.withColumn(BUCKET, spot).hint("rebalance", F.col(BUCKET)), [BUCKET])
                seen[name] = {b: own.get(b) for b in touched}
                made[name] = ([f"{folder}/{f}" for f in self._folders(name, folder)], n, new.schema.json())

            def change(tables, seen=seen, made=made):
                out = dict(tables)
                for name, (folders, n, schema) in made.items():
                    now = _by_bucket(tables.get(name, []))
                    if any(now.get(b) != f for b, f in seen[name].items()):
                        raise Stale(name)
                    stay = [f for b, f in sorted(now.items()) if b not in seen[name]]
                    out.update({name: stay + folders, f"{name}/buckets": [str(n)], f"{name}/schema": [schema]})
                return out

            try:
                self._commit(change)
            except Stale:
                continue
            return {name: list(s) for name, s in seen.items()}
        raise RuntimeError(f"no merge into {', '.join(changes)} in {COMMIT_TRIES} tries")

    def _folders(self, name: str, folder: str) -> list[str]:
        """The bucket folders of a staged version (an empty bucket has none)."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{folder}")
        names = [s.getPath().getName() for s in self._files().listStatus(path)]
        return sorted(n for n in names if n.startswith(f"{BUCKET}="))


def _by_bucket(folders: list[str]) -> dict[int, str]:
    return {int(f.rsplit("=", 1)[1]): f for f in folders}


def _schema(entry: list[str]) -> T.StructType:
    return T.StructType.fromJson(json.loads(entry[0]))


def _without(tables: dict, *names: str) -> dict:
    """The manifest without what it says of these tables' buckets."""
    gone = {f"{n}/{what}" for n in names for what in ("buckets", "schema")}
    return {k: v for k, v in tables.items() if k not in gone}


def _replacing(keys: tuple[str, ...]):
    return lambda old, rows: old.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(rows)


def summary_cache_lookup(cache: DataFrame, keys: DataFrame, key: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of ``keys`` against the cache table."""
    c = cache.select(key).distinct()
    return keys.join(c, key, "left_semi"), keys.join(c, key, "left_anti")


def to_json_lines(df: DataFrame, path: str) -> None:
    """JSON sink (one document per row)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
