"""Shared helpers: the shared folder, intermediate tables, token hashes, numpy views of Arrow lists."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: XXH64 of no bytes with Spark's seed 42: the hash of the empty token that splitting leaves at a text's edges.
EMPTY_HASH = np.int64(-7444071767201028348)
WORD_EDGE = r"[^\p{L}\p{N}]+"
#: Bytes of a table (rows times the width its caller states) that may be sent to every executor.
BROADCAST_BYTES = 32 << 20
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor shares, as the cluster names it in spark.checkpoint.dir.

    Only a local session may leave it unset; it then gets a folder of its own, once an application.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="wordkiln-")
    return "file://" + _local[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/wordkiln/{uuid.uuid4().hex}/{label}"


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, whatever executors are lost."""
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by stored(); call it once nothing lazy reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage: the cleaner then deletes the shuffle files of what nobody can read any more."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_hashes(text: Column) -> Column:
    """array<long>: XXH64 of each lower-case run of letters and digits, in order; edges may leave EMPTY_HASH. Null gives []."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_EDGE), lambda w: F.xxhash64(w))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets (from 0) of an Arrow list array without nulls."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.concatenate([[0], np.cumsum(lengths)])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64, copy=True) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def parts(n_rows: int, target: int, least: int = 1) -> int:
    return max(least, -(-n_rows // target))


def fits(df: DataFrame, width: int) -> bool:
    """Whether df's rows, counted, take at most BROADCAST_BYTES at width bytes each."""
    return df.count() * width <= BROADCAST_BYTES


def bounded(df: DataFrame, width: int) -> DataFrame:
    """df marked for broadcast if it fits(); else as it is."""
    return F.broadcast(df) if fits(df, width) else df


def record_key(docs: DataFrame, key: str) -> Column:
    """The key as a long. Keys must be whole numbers: results carry them, and order and least keys are theirs."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be a column of whole numbers, not {docs.schema[key].dataType.simpleString()}")
    return docs[key].cast("long")


def free_name(columns: list[str], name: str) -> str:
    """name, or with underscores in front of it, so that no column bears it (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def runs(batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of key, which comes sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(key).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = [b.slice(cut)]
        elif held and held[-1].column(key)[0].as_py() != ids[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
