"""What the training-data operators share: table access, Arrow batch limits and lineage cuts."""

from __future__ import annotations

import struct
import tempfile
import uuid
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch. They bound a Python worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it; any path that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to `rows` rows and BATCH_BYTES, for the session and from here on.

    The settings are read when a plan runs, so they cannot be put back before; a session that has
    smaller limits keeps them.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key) if str(spark.conf.get(key)).lstrip("-").isdigit() else 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Keys that more than one row in HOT_SHARE has, at most as many, go out by broadcast.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, small: DataFrame, by: list[str], times: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `small` (one row a key, and how `times` it is in `rows`), split by how hot a key is.

    At most HOT_SHARE keys can each have more than `total` / HOT_SHARE of the rows: these are broadcast
    and their rows stay where they are; the others meet by a shuffle. `times` is dropped. Rows with a
    null in `by` match nothing; a left join keeps them. Both inputs are read more than once: give written tables.
    """
    hot = F.col(times) * HOT_SHARE > F.lit(total)
    few = F.broadcast(small.where(hot).drop(times))
    known = reduce(and_, [F.col(c).isNotNull() for c in by])
    rest = rows.where(known).join(F.broadcast(small.where(hot).select(*by)), by, "left_anti")
    out = rows.join(few, by).unionByName(rest.join(small.where(~hot).drop(times), by, how))
    return out.unionByName(rows.where(~known), allowMissingColumns=True) if how == "left" else out


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is named, a session on one machine gets a temporary one; on a cluster that is an error,
    for its executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = known or tempfile.mkdtemp(prefix="plotwright-")
        if not known:
            spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plotwright/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(*arrays: np.ndarray) -> bytes:
    """Some numpy arrays as one byte string; `unpack` gives them back."""
    head = struct.pack("<B", len(arrays))
    for a in arrays:
        head += struct.pack("<2sq", a.dtype.str[1:].encode(), len(a))
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays that `pack` put into `blob`."""
    n, at, kinds = blob[0], 1, []
    for _ in range(n):
        kinds.append(struct.unpack_from("<2sq", blob, at))
        at += struct.calcsize("<2sq")
    out = []
    for kind, size in kinds:
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(blob, dtype, size, at))
        at += size * dtype.itemsize
    return out
