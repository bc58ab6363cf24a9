"""Keeping tables up to date from streams with the same transitions as in batch.

A micro-batch can be delivered twice after a failure. Keyed transitions converge when
repeated, so they run in ``foreachBatch``; plain appends publish the files of a batch once.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Incremental, Partitioned, Scd1, Scd2, TableConfig
from ..functions.columns import column, key_list
from ..operators.schema import conform
from ..plans import commit, materialize
from ..scratch import move_files, path_exists, remove_folder, write_mark

_KEYED = (Incremental, Partitioned, Scd1, Scd2)


def _fit_for_streams(config: TableConfig) -> TableConfig:
    if not isinstance(config, _KEYED) or not key_list(config.unique_key):
        raise ValueError("only keyed tables can be refreshed from a stream; use append_stream to append")
    if isinstance(config, Scd2) and config.invalidate_hard_deletes:
        raise ValueError("a micro-batch is not a full extract: set invalidate_hard_deletes=False")
    if isinstance(config, Incremental) and config.incremental_strategy != "merge":
        raise ValueError("only the merge strategy converges when a micro-batch is repeated")
    if isinstance(config, (Incremental, Partitioned)) and config.incremental_column:
        raise ValueError("the stream's checkpoint takes the place of incremental_column")
    if not isinstance(config, Scd2) and key_list(config.dedupe_order_by):
        config = replace(config, newest_wins=True)  # also against rows of earlier batches
    return config


def refresh_stream(
    stream: DataFrame,
    config: TableConfig,
    checkpoint: str,
    *,
    run_ts_column: str | None = None,
    continuous: str | None = None,
) -> StreamingQuery:
    """Apply each micro-batch of ``stream`` to the table ``config`` describes.

    ``config.source`` is ignored. ``run_ts_column`` dates a batch by the greatest value in
    it, which is the same when the batch is repeated. By default everything available is
    processed and the query ends; ``continuous`` gives a processing-time interval instead.
    """
    config = _fit_for_streams(config)
    session = stream.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        run_ts = None
        if run_ts_column:
            run_ts = batch.agg(F.max(column(run_ts_column)).alias("at")).first()["at"]
            if run_ts is None:
                return  # an empty batch
        materialize(batch.sparkSession, replace(config, source=batch), run_ts=run_ts, count_rows=False)
        # Batches run in a session of their own; the caller's must not keep the old files.
        session.catalog.refreshTable(config.target_table)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def append_stream(stream: DataFrame, table: str, checkpoint: str, *, continuous: str | None = None) -> StreamingQuery:
    """Append a stream to an unpartitioned parquet table exactly once, creating it if absent.

    A batch is written to a hidden folder inside the table's and its files are then moved into
    place under names of their own, so rows of the table and of batch appends all stay visible. A batch delivered
    again finds its folder complete and only moves what is left, or finds the mark that it was published.
    Marks lie in the checkpoint, where a rewrite of the table does not reach them; only the
    last batch can come again, so earlier marks are removed.
    """
    session = stream.sparkSession
    if not commit.table_exists(session, table):
        commit.create(session.createDataFrame([], stream.schema), table)
    partitions, details = commit.described(session, table)
    if partitions or details.get("Provider", "").lower() != "parquet":
        raise ValueError(f"{table} is not an unpartitioned parquet table")
    own = f"_appending-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"
    marks = f"{checkpoint.rstrip('/')}/published"
    if path_exists(session, f"{details['Location'].rstrip('/')}/_spark_metadata"):
        raise ValueError(f"{table} has a file sink's log, which hides other files; copy it to a new table")

    def publish(batch: DataFrame, batch_id: int) -> None:
        if path_exists(session, f"{marks}/batch-{batch_id}"):
            return
        location = commit.described(session, table)[1]["Location"].rstrip("/")  # a rewrite moves it
        folder = f"{location}/{own}/batch-{batch_id}"
        if not path_exists(session, f"{folder}/_SUCCESS"):
            conform(batch, session.table(commit.table_name(table))).write.mode("overwrite").parquet(folder)
        move_files(session, folder, location, ".parquet")
        write_mark(session, f"{marks}/batch-{batch_id}")
        remove_folder(session, f"{location}/{own}")
        remove_folder(session, f"{marks}/batch-{batch_id - 1}")
        session.catalog.refreshTable(table)

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()
