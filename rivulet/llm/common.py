"""What the operators share: written intermediate tables and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return (Java regex).
WHITE = "[\\x20\\x09-\\x0D]+"
#: The same characters, for trim().
BLANKS = " \t\n\x0b\f\r"

#: Most bytes of a table that may be broadcast, as fits() counts them, and most rows.
BROADCAST_BYTES, BROADCAST_ROWS = 48 << 20, 500_000
#: Rows of one key from which on they are joined where they lie instead of meeting in one task.
HOT_ROWS = 1_000_000

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="rivulet-"))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rivulet-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Recent(dict):
    """A table of made values, bounded: what has not been asked for within two generations goes.

    Keys longer than LONGEST are made each time.
    """

    GENERATION, LONGEST = 350_000, 64

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def put(self, key: str, value) -> None:
        if len(key) <= self.LONGEST:
            if len(self) >= self.GENERATION:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value


def ship(docs: DataFrame) -> DataFrame:
    """Send this package's sources to the executors, once a session, so that Python workers can import it anywhere."""
    sc = docs.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="rivulet-ship-")) / "rivulet_sources.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(archive))
    return docs


def slices(batches, rows: int = 1000, size: int = 8 << 20, column: int = 1):
    """Arrow batches in parts of at most so many rows and, but for a single longer row, bytes of a column, so that a Python worker holds the objects of one part only."""
    for b in batches:
        if not b.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = upto[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield b.slice(start, stop - start)
            start = stop


def lean(run):
    """run, a function for mapInArrow, in a worker that gives freed memory back to the system before and after it.

    Python workers outlive their tasks, and an executor has more of them than cores;
    malloc (where it is glibc's) would keep in each of them most of what its largest task freed, of any operator.
    """

    def trim():
        with contextlib.suppress(AttributeError, OSError, TypeError):
            ctypes.CDLL(None).malloc_trim(0)

    def out(batches):
        trim()
        yield from run(batches)
        trim()

    return out


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _width(field) -> Column:
    """Bytes of a column's value beyond its slot."""
    kind = field.dataType.typeName()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(field.name), F.lit(0)).cast("long")
    if kind == "array":
        return 16 * F.greatest(F.size(field.name), F.lit(0)).cast("long")
    return F.lit(0).cast("long")


def fits(small: DataFrame, bound: int | None = None) -> bool:
    """Whether a count proves a written table within the bounds of rows and bytes: 32 bytes a row, 16 a column, and the length of strings and arrays."""
    bound = BROADCAST_ROWS if bound is None else bound
    extra = sum((_width(f) for f in small.schema), F.lit(0).cast("long"))
    n, more = small.limit(bound + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(extra), F.lit(0))).first()
    return n <= bound and n * (32 + 16 * len(small.columns)) + more <= BROADCAST_BYTES


def with_bound(small: DataFrame, bound: int | None = None) -> DataFrame:
    """Mark a written table for broadcast only if it fits; otherwise joins shuffle."""
    return F.broadcast(small) if fits(small, bound) else small


def keyed_join(big: DataFrame, small: DataFrame, key: str, often: str, how: str = "inner") -> DataFrame:
    """big joined with small, a written table of one row a key that counts big's rows of that key in the column often.

    A small table is broadcast.  Otherwise both sides shuffle, but for keys of
    more than HOT_ROWS rows: there are at most (rows of big) / HOT_ROWS of
    them, and these are broadcast, so that no task gathers a hot key.
    """
    if fits(small):
        return big.join(F.broadcast(small), key, how)
    hot = small.where(F.col(often) > HOT_ROWS)
    if hot.isEmpty():
        return big.join(small, key, how)
    names = F.broadcast(hot.select(key))
    apart = big.join(names, key, "left_semi").join(F.broadcast(hot), key)
    return apart.unionByName(big.join(names, key, "left_anti").join(small.where(F.col(often) <= HOT_ROWS), key, how))


def words(text: Column) -> Column:
    """The words of a text: runs without ASCII white space; an empty array if there are none."""
    return F.array_remove(F.split(text, WHITE), "")


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where rules would copy it into body."""
    return F.transform(F.array(value), body)[0]
