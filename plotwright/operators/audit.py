"""The audit log as a hash chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: The columns that a digest covers, in key order.
COVERED = ("action", "at", "detail", "document_id", "field_key", "new_value", "old_value", "role", "user_id", "username")


def canonical(*columns: str) -> Column:
    """One row as JSON with sorted keys, nulls included, no spaces."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def digest(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit(GENESIS)), F.lit("\n"), payload), 256)


def _folded(log: DataFrame, columns: tuple[str, ...], chain_col: str | None, order_col: str) -> DataFrame:
    """`log` (with prev_hash and entry_hash) with the hashes of entries that have none, each chained to the entry before it.

    The rows of a chain go to one task in order and pass through it as a stream: what it holds is a
    batch and the last hash, and the time is linear in the chain. Entries of one place are taken
    stored ones first, then by content.
    """
    key, names = [chain_col] if chain_col else [], log.columns
    rows = log.withColumn("_p", canonical(*columns))
    rows = (rows.repartition(*key) if key else rows.repartition(1)).sortWithinPartitions(*key, order_col, F.col("entry_hash").asc_nulls_last(), "_p")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, tip = object(), None
        for b in batches:
            before, own = b.column("prev_hash").to_pylist(), b.column("entry_hash").to_pylist()
            chains = b.column(chain_col).to_pylist() if chain_col else [None] * len(own)
            for n, (c, payload) in enumerate(zip(chains, b.column("_p").to_pylist(), strict=True)):
                if c != chain:
                    chain, tip = c, None
                if own[n] is None:
                    before[n] = tip
                    own[n] = hashlib.sha256(f"{GENESIS if tip is None else tip}\n{payload}".encode()).hexdigest()
                tip = own[n]
            new = {"prev_hash": pa.array(before, pa.string()), "entry_hash": pa.array(own, pa.string())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    return rows.mapInArrow(fold, log.schema)


def build(log: DataFrame, columns: tuple[str, ...], chain_col: str | None = None, order_col: str = "id") -> DataFrame:
    """The log with prev_hash and entry_hash.

    A chain is a fold in order, so each chain is built in one task; with `chain_col` there is a
    chain per value, which is how a large log stays parallel. Entries without a value are a chain too.
    """
    none = F.lit(None).cast("string")
    return _folded(log.withColumn("prev_hash", none).withColumn("entry_hash", none), columns, chain_col, order_col)


def seal(log: DataFrame, columns: tuple[str, ...], chain_col: str | None = None, order_col: str = "id") -> DataFrame:
    """The log with hashes for the entries that have none: each is chained to the entry before it. Stored hashes stay."""
    return _folded(log, columns, chain_col, order_col)


def verify(log: DataFrame, columns: tuple[str, ...], chain_col: str | None = None, order_col: str = "id") -> DataFrame:
    """Per chain: ok, entries, verified (0 on any failure), and the first bad row with its reason.

    Stored hashes are compared, so rows are checked in parallel within a chain's order; only the
    neighbour's hash is looked up.
    """
    key = [chain_col] if chain_col else []
    w = Window.partitionBy(*key).orderBy(order_col)
    checked = log.withColumn("_before", F.lag("entry_hash").over(w))
    reason = F.when(~F.col("prev_hash").eqNullSafe(F.col("_before")), "broken_link").when(F.col("entry_hash") != digest(F.col("_before"), canonical(*columns)), "content_altered")
    bad = checked.withColumn("_reason", reason)
    first = F.min_by(F.struct(F.col(order_col).alias("at"), F.col("_reason").alias("reason")), F.when(F.col("_reason").isNotNull(), F.col(order_col)))
    g = bad.groupBy(*key).agg(F.count("*").alias("entries"), F.count("_reason").alias("bad"), first.alias("first"))
    ok = F.col("bad") == 0
    return g.select(*key, ok.alias("ok"), "entries", F.when(ok, F.col("entries")).otherwise(0).alias("verified"), F.when(~ok, F.col("first.at")).alias("broken_at"), F.when(~ok, F.col("first.reason")).alias("reason"))


def trail(log: DataFrame, document_id: int | None = None, limit: int = 200) -> DataFrame:
    """The newest entries, of one record or of all."""
    rows = log if document_id is None else log.where(F.col("document_id") == document_id)
    return rows.orderBy(F.desc("id")).limit(limit)
