"""A table of the newest version per key that is merged in the background while it is read.

Rows lie in a fixed number of buckets by a hash of their key, each in one or more immutable parts. A version of
the table is a small file that names every bucket's parts; what is not named does not exist. A merge writes
new parts beside the old ones and then creates the next version file, which fails if another writer was
faster. So readers see a version whole or not at all, a crash on the way leaves only files that nobody
names, and nothing is ever swapped or overwritten.

Only buckets that get rows change. Where none of the new keys is in the bucket yet (looked up in its key
columns alone), the new rows become a part of their own; else, or when there are too many parts, the bucket is
merged and rewritten. A writer that lost the race redoes only the buckets that have changed meanwhile.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .latest import latest_by_key

BUCKETS = 64
#: a bucket with so many parts is rewritten as one
MOST_PARTS = 8


class ConcurrentWriters(RuntimeError):
    """Other writers were faster too many times in a row."""


class CompactedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: str = "ingested_at", buckets: int = BUCKETS):
        """The table at ``path`` (need not exist yet): its newest row per ``keys`` by ``version``, ties by the other
        columns (`latest_by_key`). ``buckets`` only counts for a new table."""
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path.rstrip("/"), list(keys), version, buckets

    # ---- versions ---------------------------------------------------------------------

    def _files(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._files(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def _version_path(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def manifest(self, number: int | None = None) -> dict:
        """``number``, ``buckets``, ``schema`` and ``parts`` (bucket → paths under the table) of a version, by default the
        newest. A table without versions has number 0 and no parts."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return {"number": 0, "buckets": self.buckets, "schema": None, "parts": {}}
        text = self.spark.read.text(self._version_path(number), wholetext=True).first()[0]
        return json.loads(text)

    def _create(self, manifest: dict) -> bool:
        """Writes the version file under a name of its own and gives it the version's; False if that exists."""
        jvm = self.spark._jvm
        target, fs = self._files(self._version_path(manifest["number"]))
        draft, _ = self._files(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, target, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # ---- reading ----------------------------------------------------------------------

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of one version; later merges do not touch it."""
        m = self.manifest(number)
        if m["schema"] is None:
            raise FileNotFoundError(f"no version of the table at {self.path}")
        return self._rows(m, sorted(m["parts"], key=int)).select(*self._schema(m).names)

    def _schema(self, m: dict) -> T.StructType:
        return T.StructType.fromJson(m["schema"])

    def _rows(self, m: dict, buckets) -> DataFrame:
        """The rows of these buckets, with ``_bucket``; a part may hold only one bucket's rows."""
        schema = T.StructType([*self._schema(m).fields, T.StructField("_bucket", T.IntegerType())])
        paths = [f"{self.path}/{p}" for b in buckets for p in m["parts"].get(str(b), [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    # ---- merging ----------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Bucket → part of ``rows``, each bucket in files of its own. The rows are written as they lie, by key: a
        bucket is many tasks' work and travels no second time."""
        folder = f"data/run={uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        at, fs = self._files(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def merge(self, rows: DataFrame, attempts: int = 10) -> int:
        """Merges ``rows`` (the table's columns) and returns the version that holds them. Merging the same rows again
        changes nothing that a reader sees. Rows without a key column are kept under their null key."""
        bucket = lambda n: F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")
        m = self.manifest()
        names = rows.columns if m["schema"] is None else self._schema(m).names
        newest = latest_by_key(rows.select(*names), self.keys, self.version)
        fresh = self._write(newest.withColumn("_bucket", bucket(m["buckets"])))
        if not fresh:
            return m["number"]
        known = {"schema": json.loads(rows.select(*names).schema.json()), "parts": {b: [p] for b, p in fresh.items()}}
        done: dict[str, list[str]] = {}
        seen: dict[str, list[str]] = {}
        for _ in range(attempts):
            # buckets not merged yet, or changed by others since
            todo = [b for b in fresh if b not in done or seen[b] != m["parts"].get(b, [])]
            done |= self._merged({**m, "schema": m["schema"] or known["schema"]}, known, todo)
            seen |= {b: m["parts"].get(b, []) for b in todo}
            following = {"number": m["number"] + 1, "buckets": m["buckets"], "schema": m["schema"] or known["schema"], "parts": {**m["parts"], **done}}
            if self._create(following):
                return following["number"]
            before, m = m, self.manifest()
            if before["buckets"] != m["buckets"]:  # the table was created by another, with other buckets
                return self.merge(rows, attempts - 1)
        raise ConcurrentWriters(f"{attempts} other writers were faster")

    def _merged(self, m: dict, known: dict, buckets: list[str]) -> dict[str, list[str]]:
        """The parts of these buckets with the new rows in them."""
        old = {b: m["parts"].get(b, []) for b in buckets}
        filled = [b for b in buckets if old[b]]
        met: set[str] = {b for b in filled if len(old[b]) + 1 > MOST_PARTS}
        asked = [b for b in filled if b not in met]
        if asked:
            # key columns only; which buckets, never which keys, reaches the driver
            both = functools.reduce(lambda on, k: on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), self.keys, F.col("a._bucket") == F.col("b._bucket"))
            held = self._rows(m, asked).select(*self.keys, "_bucket").alias("a")
            hits = held.join(self._rows({**m, **known}, asked).select(*self.keys, "_bucket").alias("b"), both, "left_semi")
            met |= {str(r[0]) for r in hits.select("_bucket").distinct().collect()}
        out = {b: [*old[b], *known["parts"][b]] for b in buckets}
        if met:
            order = sorted(met, key=int)
            rows = self._rows(m, order).unionByName(self._rows({**m, **known}, order))
            rewritten = self._write(latest_by_key(rows, [*self.keys, "_bucket"], self.version))
            out |= {b: [p] for b, p in rewritten.items()}
        return out

    def expire(self, keep: int = 10) -> int:
        """Deletes all but the newest ``keep`` version files and returns how many. Parts stay: a reader of an old version
        may still be at work on them."""
        old = self.versions()[:-keep] if keep > 0 else []
        for number in old:
            at, fs = self._files(self._version_path(number))
            fs.delete(at, False)
        return len(old)
