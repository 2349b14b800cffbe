"""A table kept as snapshots in shared storage: streams change it batch by batch, a batch that comes again changes nothing.

The rows lie in buckets by a key, a folder of Parquet files each. A commit writes the buckets it touches anew, into a folder of its own, and
leaves the rest where it is. Then it publishes a pointer: a small file that names the folder of every bucket and the last batch of
every stream. Pointers are numbered, and the next one appears by one rename that fails if it is there already, so a reader sees the
table before or after a commit, never between, and of two writers one has to start again from the other's result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has published the version that this one was about to."""


class Snapshots:
    """Snapshots below `root`, a folder that all executors see. buckets: a constant of the table from its first commit on."""

    def __init__(self, spark: SparkSession, root: str, key: str = "filename", buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _files(self, path) -> list[str]:
        """Names below a folder; none if there is no such folder."""
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._files(self._path("versions")) if n.isdigit())

    def pointer(self, version: int | None = None) -> dict:
        """What a version, the newest if none is named, points to; version 0 is the empty table without columns."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "buckets": self.buckets, "schema": None, "batches": {}, "parts": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/versions/{version:020d}").first()[0]
        return json.loads(text)

    def _publish(self, pointer: dict) -> None:
        new, target = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{pointer['version']:020d}")
        fs = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self._hadoop, "Options$Rename")
        once = self.spark.sparkContext._gateway.new_array(rename, 1)
        once[0] = rename.NONE
        try:
            context.rename(new, target, once)
        except Exception as e:  # py4j wraps what the file system throws
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(pointer["version"]) from None
            raise

    def _bucket(self, column: Column, many: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(many)).cast("int")

    def load(self, version: int | None = None) -> DataFrame:
        """The table of a version, the newest if none is named: what is read stays the same, whatever is committed meanwhile."""
        return self._table(self.pointer(version))

    def _table(self, pointer: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(pointer["schema"]) if pointer["schema"] else StructType()
        own = [p for b, p in pointer["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def commit(self, stream: str, batch: int, keys: DataFrame, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> bool:
        """Applies a change to the rows whose key is in the buckets of `keys`, as batch number `batch` of a stream; False if it has been applied already.

        change gets these buckets' rows (no columns before the first commit) and must give rows of the same buckets; it is called again if
        another writer was faster. The first commit fixes the columns: later rows get nulls for those they lack, and may have no others.
        """
        for left in reversed(range(tries)):
            old = self.pointer()
            if old["batches"].get(stream, -1) >= batch:
                return False
            many = old["buckets"]
            own = [r[0] for r in keys.select(self._bucket(F.col(self.key), many)).distinct().collect()]  # `buckets` numbers at most
            made = change(self._table(old, own))
            if old["schema"]:
                schema = StructType.fromJson(old["schema"])
                if extra := set(made.columns) - set(schema.names):
                    raise ValueError(f"columns that the table doesn't have: {sorted(extra)}")
                made = made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            schema = old["schema"] or StructType.fromJson(made.schema.jsonValue()).jsonValue()
            folder = f"{self.root}/data/{stream}-{batch}-{uuid.uuid4().hex}"
            # rebalanced: a bucket of many rows is several tasks, small ones share one
            made.withColumn("_bucket", self._bucket(F.col(self.key), many)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
            written = {n.split("=")[1]: f"{folder}/{n}" for n in self._files(self._hadoop.Path(folder)) if n.startswith("_bucket=")}
            if stray := set(map(int, written)) - set(own):
                raise ValueError(f"a change of buckets {sorted(own)} gave rows of {sorted(stray)}")
            parts = {b: p for b, p in old["parts"].items() if int(b) not in own} | written
            try:
                self._publish({"version": old["version"] + 1, "buckets": many, "schema": schema, "batches": old["batches"] | {stream: batch}, "parts": parts})
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the data folders that none of the newest `keep` versions points to, and older pointers; readers of these must have ended."""
        last = self.versions()[-keep:]
        used = {p.split("/data/")[1].split("/")[0] for v in last for p in self.pointer(v)["parts"].values()}
        gone = [n for n in self._files(self._path("data")) if n not in used]
        old = [f"{v:020d}" for v in self.versions() if v not in last]
        for path in [self._path("data", n) for n in gone] + [self._path("versions", n) for n in old]:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone


