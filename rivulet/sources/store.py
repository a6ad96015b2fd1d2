"""Versioned Z-set storage: each table is a list of Parquet segments; reading adds them up.

A batch appends one segment per changed table, so it writes in proportion to the
change.  A table with many segments is rewritten consolidated.  A pointer file
names all segments of a version.  Every version has a pointer of its own, written
under another name and then renamed, and the highest whole one counts; so a
version is there whole or not at all.  What neither the present state, the batch
before, nor the last published version names is deleted.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rivulet.errors import ViewError
from rivulet.functions import zset as Z

MOST_SEGMENTS = 12
_POINTER = re.compile(r"pointer-(\d+)\.json")


def _shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/rivulet-views-{uuid.uuid4().hex}"
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ViewError(501, "no shared folder", "set spark.checkpoint.dir or pass a path")
    return tempfile.mkdtemp(prefix="rivulet-views-")


class Store:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or _shared(spark)
        self.segments: dict[str, list[str]] = {}
        self.schemas: dict[str, object] = {}
        self.version = 0
        #: Folders written and not yet deleted, those of the published version, and those that were in use a batch ago.
        self._written: list[str] = []
        self._published: set[str] = set()
        self._before: set[str] = set()
        self._ones: dict[str, bool] = {}

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        at = f"{self.path}/segments/{uuid.uuid4().hex}"
        self._written.append(at)
        df.write.parquet(at)
        return at, self._rows_of(self.spark.read.schema(df.schema).parquet(at), [at])

    def _rows_of(self, df: DataFrame, segments: list[str]) -> DataFrame:
        if Z.W in df.columns:
            df._all_ones = lambda: all(self._one(at, df.schema) for at in segments)
        return df

    def _one(self, at: str, schema) -> bool:
        """Whether all weights of a segment are 1; asked once a segment, and answered by file statistics where they tell."""
        if at not in self._ones:
            self._ones[at] = self.spark.read.schema(schema).parquet(at).where(f"{Z.W} <> 1").isEmpty()
        return self._ones[at]

    def fixed(self, df: DataFrame) -> DataFrame:
        """df, computed once and written, so that several uses do not repeat it and a lost executor costs nothing."""
        return self.write(df)[1]

    def put(self, name: str, df: DataFrame) -> DataFrame:
        at, out = self.write(df)
        self.segments[name], self.schemas[name] = [at], df.schema
        return out

    def append(self, name: str, df: DataFrame) -> DataFrame:
        at, out = self.write(df)
        self.segments[name] = [*self.segments.get(name, []), at]
        self.schemas.setdefault(name, df.schema)
        return out

    def read(self, name: str) -> DataFrame:
        return self._rows_of(self.spark.read.schema(self.schemas[name]).parquet(*self.segments[name]), list(self.segments[name]))

    def full(self, name: str) -> bool:
        return len(self.segments.get(name, ())) > MOST_SEGMENTS

    def compact(self, name: str) -> None:
        if self.full(name) and Z.W in self.schemas[name].names:
            self.put(name, Z.consolidate(self.read(name)))

    def drop(self, name: str) -> None:
        self.segments.pop(name, None)
        self.schemas.pop(name, None)

    def state(self) -> tuple[dict, dict]:
        """What names the present contents, to go back to."""
        return {n: list(s) for n, s in self.segments.items()}, dict(self.schemas)

    def back(self, state: tuple[dict, dict]) -> None:
        self.segments, self.schemas = {n: list(s) for n, s in state[0].items()}, dict(state[1])

    def sweep(self) -> None:
        """Delete the folders that nothing names any more; called between batches, it spares what the batch before could read."""
        now = {at for s in self.segments.values() for at in s}
        keep = now | self._published | self._before
        for at in [x for x in self._written if x not in keep]:
            where, fs = self._fs(at)
            fs.delete(where, True)
            self._ones.pop(at, None)
        # Tables that are no segments, written for this batch alone, go with the next one.
        self._before = now | {x for x in self._written if x not in keep and self._exists(x)}
        self._written = [x for x in self._written if x in keep]

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> dict[int, str]:
        where, fs = self._fs(self.path)
        found = {}
        for f in fs.listStatus(where) if fs.exists(where) else ():
            if m := _POINTER.fullmatch(f.getPath().getName()):
                found[int(m[1])] = f.getPath().toString()
        return found

    def publish(self, more: dict) -> None:
        """Write the next version's pointer, then give it its name; older ones go afterwards."""
        version = max([self.version, *self._pointers()]) + 1
        body = json.dumps({"version": version, "segments": self.segments, "schemas": {k: v.jsonValue() for k, v in self.schemas.items()}, **more})
        tmp, fs = self._fs(f"{self.path}/_writing-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(body.encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"{self.path}/pointer-{version}.json")[0]):
            raise ViewError(502, f"cannot publish version {version}")
        self.version, self._published = version, {at for s in self.segments.values() for at in s}
        for v, path in self._pointers().items():
            if v < version:
                fs.delete(self._fs(path)[0], False)

    def restore(self) -> dict:
        from pyspark.sql.types import StructType

        for _, path in sorted(self._pointers().items(), reverse=True):
            try:
                found = json.loads(self.spark.read.text(path, wholetext=True).first()[0])
            except (ValueError, TypeError):
                continue  # not whole
            self.version, self.segments = found["version"], found["segments"]
            self.schemas = {k: StructType.fromJson(v) for k, v in found["schemas"].items()}
            self._published = {at for s in self.segments.values() for at in s}
            self._written = sorted(self._published)
            return found
        raise ViewError(503, f"nothing saved in {self.path}")
