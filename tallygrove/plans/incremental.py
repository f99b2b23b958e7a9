"""Measure what the store does not know, keep it, answer from the store."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.measure import measure, normalise
from tallygrove.operators.store import answer, few, misses_of
from tallygrove.session import materialise
from tallygrove.sinks.store import ResultStore


def incremental_run(
    requests: DataFrame,
    store: ResultStore,
    vocab: DataFrame | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
    exact: bool = False,
    unique: bool = False,
    seq: int | None = None,
) -> DataFrame:
    """(pos, path, content, tokens, error), one row per request; for `unique` paths without `pos`.

    `requests` has (pos, path, mtime, …), `pos` telling requests apart. `read` adds
    `content` (and `error`) to those missing in the store; by default the column is there.
    With `unique` paths, an empty store is filled without any exchange of contents.
    Running the same requests again computes nothing. Rows with an error are answered but
    not kept, so a file that can be read later is tried again.
    """
    seq = store.next_seq() if seq is None else seq
    cut = few(requests)
    fields = ["path", "content", "tokens", "error"]
    first = unique and store.is_empty(seq)
    if first:
        missing = requests
    else:
        # One lookup, slim and written: it says what to measure, and later where answers lie.
        met = materialise(store.met(requests, seq, exact, cut, unique))
        missing = misses_of(met, requests)
    texts = read(missing) if read else missing
    store.append(measure(texts, vocab, table=read is None), seq=seq)

    # What was measured answers for what missed; nothing has to be looked up again.
    written = store.written(seq)
    results = written.select(*fields)
    if not first:
        results = store.hits(met, seq).select(*fields).unionByName(results)
    if read or "error" in requests.columns:
        # What missed and was not written could not be read.
        kept = written.select(F.col("path").alias("_kept"))
        unread = missing.join(kept, F.col("path").eqNullSafe(F.col("_kept")), "left_anti")
        failed = normalise(read(unread) if read else unread)
        results = results.unionByName(
            failed.withColumn("tokens", F.lit(0).cast("bigint")).select(*fields)
        )
    if unique:
        return results
    return answer(requests, results, cut)
