"""Files below a root, hidden names included: listing and reading are separate jobs.

A location is a path that all executors see, or a URI that pyarrow can open. Listing goes
level by level: every directory of a level is one row, spread evenly over the tasks; the
entries of a local directory are streamed, those of a URI come as one list a directory. Entries
that vanish meanwhile or may not be read are left out; any other failure is tried again, then
raised, so a listing is whole or fails. Contents are read only for the files that are left
after path rules and store lookup.
"""

import os
import time
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions.text import version_seconds
from tallygrove.schemas import LISTING
from tallygrove.session import scratch_dir
from tallygrove.sources.decode import READ_ERROR

ENTRIES_PER_BATCH = 10_000
BYTES_PER_BATCH = 32 << 20
BYTES_PER_TASK = 256 << 20
LARGEST = (1 << 31) - 1  # bytes that one value of a column can hold
ATTEMPTS = 4
WAIT = 0.5  # seconds, doubled with each attempt

# An entry that went meanwhile, or that may not be read, is left out of a listing.
SKIPPED = (FileNotFoundError, NotADirectoryError, PermissionError)

_ENTRY = "path string, length bigint, mtime bigint, is_dir boolean"


_MOUNTED = {}  # file systems a task has opened, by scheme and host


def _opened(uri: str) -> tuple:
    """File system, and path in it, of a URI whose path may hold any character."""
    scheme, rest = uri.split("://", 1)
    host, _, path = rest.partition("/")
    top = f"{scheme}://{host}/"
    if top not in _MOUNTED:
        _MOUNTED[top] = fs.FileSystem.from_uri(top)
    files, base = _MOUNTED[top]
    return files, f"{base.rstrip('/')}/{path}"


def _entries(directory: str) -> Iterator[tuple]:
    """(path, length, mtime, is_dir) of a directory; links are left out."""
    if "://" in directory:
        files, inner = _opened(directory)
        for info in files.get_file_info(fs.FileSelector(inner)):
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                changed = int(max(info.mtime.timestamp(), 0)) if info.mtime else 0
                is_dir = info.type == fs.FileType.Directory
                yield f"{directory}/{info.base_name}", info.size or 0, changed, is_dir
        return
    with os.scandir(directory) as entries:
        for entry in entries:
            with suppress(*SKIPPED):
                is_dir = entry.is_dir(follow_symlinks=False)
                if is_dir or entry.is_file(follow_symlinks=False):
                    stat = entry.stat(follow_symlinks=False)
                    # A name that is not UTF-8 cannot be a string; it will fail to be read.
                    name = os.fsencode(entry.name).decode("utf-8", "replace")
                    changed = int(max(stat.st_mtime, 0))
                    yield f"{directory}/{name}", stat.st_size, changed, is_dir


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "length", "mtime", "is_dir"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def flush(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names=names
        )

    rows = []
    for batch in batches:
        for directory in batch.column("path").to_pylist():
            for entry in _tried(_entries, directory):
                rows.append(entry)
                if len(rows) >= ENTRIES_PER_BATCH:
                    yield flush(rows)
                    rows = []
    if rows:
        yield flush(rows)


def _tried(entries, directory):
    """What `entries` yields; after a failure from the start again, without what came already."""
    done = set()
    for attempt in range(1, ATTEMPTS + 1):
        try:
            for entry in entries(directory):
                if entry[0] not in done:
                    if attempt < ATTEMPTS:
                        done.add(entry[0])
                    yield entry
            return
        except SKIPPED:
            return
        except OSError:
            if attempt == ATTEMPTS:
                raise
            time.sleep(WAIT * 2**attempt)


def list_files(
    spark: SparkSession,
    root: str,
    tasks: int | None = None,
    prune: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(path, length, mtime) of all regular files below `root`; paths start with it.

    A file as `root` is itself the listing; a root that isn't there is an error. Runs one job
    per directory level, each written to the scratch folder. `prune` gets each level's entries
    (path, length, mtime, is_dir) and returns those of its directories that are to be listed.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    scratch = scratch_dir(spark)
    level, todo = 0, spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    found = todo.mapInArrow(_stat_root, _ENTRY).first()
    if found is None:
        raise FileNotFoundError(f"There is no file or directory {root}")
    if not found["is_dir"]:
        return spark.createDataFrame([found[:3]], LISTING)
    while not todo.isEmpty():
        target = f"{scratch}/level={level}"
        todo.repartition(tasks).mapInArrow(_list_directories, _ENTRY).write.parquet(target)
        found = spark.read.schema(_ENTRY).parquet(target)
        todo = (prune(found) if prune else found.where("is_dir")).select("path")
        level += 1
    entries = spark.read.schema(_ENTRY).option("basePath", scratch).parquet(scratch)
    return entries.where("not is_dir").select(*LISTING.fieldNames())


def _stat_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each path its entry, if there is one."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            entry = None
            if "://" in path:
                files, inner = _opened(path)
                info = files.get_file_info(inner)
                if info.type != fs.FileType.NotFound:
                    changed = int(max(info.mtime.timestamp(), 0)) if info.mtime else 0
                    entry = path, info.size or 0, changed, info.type == fs.FileType.Directory
            elif os.path.exists(path):
                stat = os.stat(path)
                entry = path, stat.st_size, int(max(stat.st_mtime, 0)), os.path.isdir(path)
            if entry:
                yield pa.RecordBatch.from_pylist([dict(zip(["path", "length", "mtime", "is_dir"], entry))])


def _stat_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stat(path):
        try:
            if "://" not in path:
                found = os.stat(path)
                return found.st_size, int(max(found.st_mtime, 0))
            files, inner = _opened(path)
            info = files.get_file_info(inner)
            if info.type != fs.FileType.NotFound:
                return info.size, int(max(info.mtime.timestamp(), 0)) if info.mtime else 0
        except OSError:
            pass
        return None, int(time.time())

    for batch in batches:
        stats = [stat(path) for path in batch.column("path").to_pylist()]
        found = [pa.array([s[i] for s in stats], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            batch.columns + found, names=[*batch.schema.names, "length", "mtime"]
        )


def stat_files(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds `length` and `mtime` to (path, …). A file that is not there has no length and is
    as new as can be, so that nothing stored answers for it."""
    tasks = tasks or paths.sparkSession.sparkContext.defaultParallelism
    schema = T.StructType(paths.schema.fields).add("length", "long").add("mtime", "long")
    return paths.repartition(tasks).mapInArrow(_stat_files, schema)


def _read_bytes(path: str) -> bytes:
    if "://" in path:
        files, inner = _opened(path)
        with files.open_input_stream(inner) as stream:
            return stream.read()
    with open(path, "rb") as stream:
        return stream.read()


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents, errors, held, start = [], [], 0, 0

        def flush(rows, contents, errors):
            read = [pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
            return pa.RecordBatch.from_arrays(
                rows.columns + read, names=[*rows.schema.names, "content", "error"]
            )

        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            try:
                too_long = (length or 0) > LARGEST
                content, error = b"" if length == 0 or too_long else _read_bytes(path), None
                if too_long or len(content) > LARGEST:
                    content, error = b"", f"{READ_ERROR}: more than {LARGEST} bytes"
            except OSError as failure:
                content, error = b"", f"{READ_ERROR}: {failure.strerror or failure}"
            contents.append(content)
            errors.append(error)
            held += len(content)
            if held >= BYTES_PER_BATCH:
                yield flush(batch.slice(start, len(contents)), contents, errors)
                start += len(contents)
                contents, errors, held = [], [], 0
        if contents:
            yield flush(batch.slice(start, len(contents)), contents, errors)


def read_contents(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds `content` (binary) and `error` to (path, length, …); empty files are not opened.

    The listing is spread anew first, so that one large directory is read by all tasks: one
    for BYTES_PER_TASK, and one for each core at least.
    """
    if tasks is None:
        cores = listing.sparkSession.sparkContext.defaultParallelism
        total = listing.agg(F.sum("length")).first()[0] or 0
        tasks = max(cores, total // BYTES_PER_TASK)
    schema = T.StructType(listing.schema.fields).add("content", "binary").add("error", "string")
    return listing.repartition(tasks).mapInArrow(_read_files, schema)


def scan_visible_files(spark: SparkSession, root: str, min_length: int = 0) -> DataFrame:
    """(path, length, mtime, content binary) by Spark's own binary reader.

    It leaves out empty files and every name that starts with `.` or `_`, and follows links.
    `min_length` is pushed into the scan; columns not used are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") >= min_length).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        "length",
        version_seconds(F.col("modificationTime")).alias("mtime"),
        "content",
    )
