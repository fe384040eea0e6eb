"""A batch sink that may be replayed: one folder per micro-batch and a ledger of finished ones.

``foreachBatch`` runs a batch again after a failure.  Here batch N writes the folder ``data/batch=N``
(overwriting what a lost attempt left) and then its ledger entry; a batch with an entry is not written again,
so a replay changes nothing, and readers never see half a batch.  A ledger entry names the first batch that a reader needs: the batch itself in
complete mode, else the last compaction, which rewrites all earlier batches as one.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager, nullcontext
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(base: str, batch_id: int) -> str:
    return os.path.join(base, "data", f"batch={batch_id}")


def _ledger(spark: SparkSession, base: str, name: str = ""):
    """The ledger's file system and a path in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(base, "ledger", name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _entries(spark: SparkSession, base: str, batch_id: int | str = "*") -> dict[int, int]:
    """Finished batch -> first batch that a reader of it needs; of all batches or one.  An entry is an empty
    file that has both in its name, so it is there wholly or not at all."""
    fs, pattern = _ledger(spark, base, f"{batch_id}-since-*")
    names = [s.getPath().getName() for s in fs.globStatus(pattern) or []]
    return {int(b): int(since) for b, _, since in (n.partition("-since-") for n in names)}


def write_batch(batch: DataFrame, batch_id: int, base: str, complete: bool = False,
                merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 16) -> None:
    """Write one micro-batch unless it has been; with ``merge`` every ``every``-th batch replaces all before it by
    their merger."""
    spark = batch.sparkSession
    if _entries(spark, base, batch_id):
        batch.write.format("noop").mode("overwrite").save()  # the operators' state is due all the same
        return
    since = batch_id
    if not complete:
        since = _entries(spark, base, batch_id - 1).get(batch_id - 1, batch_id)
        if merge is not None and batch_id % every == every - 1 and since < batch_id:
            batch, since = merge(_read(spark, base, list(range(since, batch_id))).unionByName(batch)), batch_id
    batch.write.mode("overwrite").parquet(_folder(base, batch_id))
    fs, entry = _ledger(spark, base, f"{batch_id}-since-{since}")
    fs.create(entry, True).close()


def _read(spark: SparkSession, base: str, batches: list[int]) -> DataFrame:
    return spark.read.parquet(*[_folder(base, b) for b in sorted(batches)])


def read_sink(spark: SparkSession, base: str) -> DataFrame:
    """What the finished batches have written (the last one alone in complete mode)."""
    done = _entries(spark, base)
    return _read(spark, base, [b for b in done if b >= done[max(done)]])


@contextmanager
def _state_store(spark: SparkSession):
    """RocksDB for the query that starts inside; the session's own setting comes back after."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


def run_to_table(stream_df: DataFrame, name: str, mode: str = "complete", root: str | None = None,
                 merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 16, rocksdb: bool = False) -> DataFrame:
    """Run a streaming query over what is there (``availableNow``) and return what its sink holds.

    With the same ``root`` a later call goes on where the last one ended.  ``rocksdb`` is for jobs of keyed
    processors, which need that state store; others take the session's."""
    spark = stream_df.sparkSession
    base = root or os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:8]}")
    with _state_store(spark) if rocksdb else nullcontext():
        q = (stream_df.writeStream.outputMode(mode)
             .foreachBatch(lambda batch, i: write_batch(batch, i, base, mode == "complete", merge, every))
             .option("checkpointLocation", os.path.join(base, "checkpoint"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_sink(spark, base)
