"""A stream of document versions into the result store."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrove.operators.measure import measure
from tallygrove.operators.store import misses_of
from tallygrove.sinks.store import ResultStore


def start_incremental(
    stream: DataFrame,
    store: ResultStore,
    checkpoint: str,
    vocab: DataFrame | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
    dead_letters: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Every micro-batch of (path, mtime, …) measures what the store does not have as new.

    A version older than the stored one is late and ignored. A repeated batch finds its
    rows stored and writes none. Rows that could not be read are appended, with their error,
    to Parquet at `dead_letters`; without that place they fail the batch, so none is lost
    unnoticed. `trigger` is as for `DataStreamWriter.trigger`; the
    default handles what is there and stops.
    """
    first = store.next_seq()  # above every earlier write, also after a new checkpoint

    def process(batch: DataFrame, batch_id: int) -> None:
        # Kept while it is read several times, so that rows keep their numbers, too.
        requests = batch.withColumn("pos", F.monotonically_increasing_id()).persist()
        try:
            if requests.isEmpty():
                return
            seq = first + batch_id
            missing = misses_of(store.met(requests, seq), requests)
            texts = read(missing) if read else missing
            measured = measure(texts, vocab, table=read is None).persist()
            try:
                keep_failures(measured, batch_id)
                if not measured.where("error is null").isEmpty():
                    store.append(measured, seq=seq)
            finally:
                measured.unpersist()
        finally:
            requests.unpersist()

    def keep_failures(measured: DataFrame, batch_id: int) -> None:
        failed = measured.where("error is not null").select("path", "mtime", "error")
        if dead_letters:
            # A repeated batch replaces its own directory.
            failed.write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")
        elif not failed.isEmpty():
            raise OSError(f"{failed.count()} rows could not be read: {failed.first()['error']}")

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
