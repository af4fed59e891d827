"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the query contracts, as a Java / Python character class body.
SPACE = r"\x20\x09-\x0D"
#: A word: a run of anything but that white space.
WORD = rf"[^{SPACE}]+"

_UPPER = bytes(range(65, 91))
LOWER_ASCII = bytes.maketrans(_UPPER, _UPPER.lower())

#: Rows may hold packed arrays of a megabyte: pages and row groups end by size and not by the usual number of rows.
PARQUET = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "100"}

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine, as in tests, an
    own folder is made and kept for the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tessera-shared-")
    return _own_dirs[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This ends the lineage (a lost executor costs no more than a re-read) and
    gives the optimiser the real size, so that it broadcasts a side only if
    its files are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = _new_path(spark, label)
    df.write.options(**PARQUET).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_parts(df: DataFrame, by: str, values: tuple[str, ...], label: str) -> dict[str, DataFrame]:
    """As :func:`cut`, with a table for each of the ``values`` that the column ``by`` takes."""
    spark = df.sparkSession
    path = _new_path(spark, label)
    df.write.options(**PARQUET).partitionBy(by).parquet(path)
    schema = T.StructType([f for f in df.schema.fields if f.name != by])
    out = {}
    for v in values:
        part = f"{path}/{by}={v}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        out[v] = spark.read.schema(schema).parquet(part) if there else spark.createDataFrame([], schema)
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a cut table that nothing will read any more."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(spark, name)


def so_far(spark: SparkSession) -> int:
    """How many tables this session has cut; a mark for :func:`discard_since`."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def discard_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables cut since a mark, but for those that hold files of ``keep``."""
    written = _written.get(spark.sparkContext.applicationId, [])
    files = [f for table in keep for f in table.inputFiles()[:1]]
    kept = [p for p in written[mark:] if any(p.rsplit("/", 1)[1] in f for f in files)]
    for path in written[mark:]:
        if path not in kept:
            _delete(spark, path)
    written[mark:] = kept


def release(spark: SparkSession) -> None:
    """Delete all tables that this session has cut; results that read them have to be written before."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under the same names."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def row_hash(df: DataFrame, *salt: object) -> Column:
    """A 64-bit hash of all hashable columns of a row (maps and variants are left out)."""
    usable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.lit(s) for s in salt], *usable)


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a number from 0 up to, not including, 1."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def give_back() -> None:
    """Return a Python worker's unused memory to the system; idle workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
