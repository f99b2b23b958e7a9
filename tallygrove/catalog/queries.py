"""Name to query: each takes (spark, sf_dir) and returns a DataFrame."""

import os
from collections.abc import Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.catalog import views
from tallygrove.functions import pieces
from tallygrove.functions import text as scalar
from tallygrove.functions.globs import is_glob
from tallygrove.operators import hierarchy, ranking, store
from tallygrove.operators.bpe import with_bpe_tokens
from tallygrove.operators.budgets import apply_budgets, prune_by_length
from tallygrove.operators.ignore_rules import compile_rules, drop_ignored
from tallygrove.operators.measure import measure
from tallygrove.operators.path_rules import (
    RuleSet,
    effective_rules,
    select_by_rule_sets,
    select_paths,
)
from tallygrove.plans import incremental
from tallygrove.plans.documents import IgnoringWalk, Options, merge_files
from tallygrove.session import estimated_bytes, materialise, scratch_dir, spread
from tallygrove.sinks.clustered import ClusteredStore
from tallygrove.sinks.reports import report_json, report_lines
from tallygrove.sinks.store import ResultStore
from tallygrove.sources.decode import decode_utf8
from tallygrove.sources.file_tree import list_files, read_contents, scan_visible_files
from tallygrove.sources.path_list import lookup_paths, read_path_list
from tallygrove.streaming.incremental import start_incremental

QUERIES = {}

FILE_BYTES = 32 << 20  # of a file that a stream reads, by the size of its table

RULE_SETS = (
    RuleSet("default"),
    RuleSet("english", ("*/en/*",), ("src1?/**",)),
    RuleSet("even", ("**/*[02468].txt",), ("*{0,2}.txt", "src1/**")),
    RuleSet("none", (), ()),
)


def query(function):
    QUERIES[function.__name__] = function
    return function


def measured(spark, sf_dir):
    return apply_budgets(measure(views.files(spark, sf_dir)))


def counts(spark, sf_dir):
    return measured(spark, sf_dir).select("path", "tokens")


# Measures


@query
def piece_count(spark, sf_dir):
    return measure(views.files(spark, sf_dir)).select("path", F.col("tokens").alias("pieces"))


@query
def piece_count_web(spark, sf_dir):
    files = measure(views.web(spark, sf_dir))
    return files.select("seq", "path", F.col("tokens").alias("pieces"))


@query
def piece_count_chat(spark, sf_dir):
    return measure(views.chat(spark, sf_dir)).select("path", F.col("tokens").alias("pieces"))


@query
def special_token_count(spark, sf_dir):
    doubled = F.concat("content", F.lit("  <|endoftext|> "), "content", F.lit("<|fim_prefix|>"))
    files = spread(views.files(spark, sf_dir))
    return files.select("path", pieces.piece_count(doubled).alias("pieces"))


@query
def blank_rows(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents")
    blank = F.lit(" \t\u00a0\u2003\u0085\n")
    content = F.when(F.col("doc_id") % 5 == 0, blank).otherwise(F.col("text"))
    files = documents.select(views.document_path().alias("path"), content.alias("content"))
    return measure(files).select("path", F.length("content").alias("n_chars"), "tokens")


@query
def bpe_count(spark, sf_dir):
    vocab = views.stand_in_vocab(spark, sf_dir)
    return measure(views.files(spark, sf_dir), vocab).select("path", "tokens")


@query
def bpe_count_joined(spark, sf_dir):
    """The form for a vocabulary too large to broadcast."""
    files = views.files(spark, sf_dir)
    vocab = views.stand_in_vocab(spark, sf_dir)
    return with_bpe_tokens(files, vocab, broadcast_entries=0).select("path", "tokens")


# Budgets


@query
def budget_low(spark, sf_dir):
    long = prune_by_length(views.files(spark, sf_dir), F.octet_length("content"), min_tokens=600)
    return apply_budgets(measure(long), min_tokens=600, limit_low=True).select("path", "tokens")


@query
def budget_high(spark, sf_dir):
    return apply_budgets(counts(spark, sf_dir), max_tokens=300, limit_high=True)


@query
def budget_both(spark, sf_dir):
    return apply_budgets(counts(spark, sf_dir), 200, 1000, limit_high=True, limit_low=True)


# Path rules


@query
def glob_include(spark, sf_dir):
    patterns = ("*/en/*1.txt", "src1?/fr/**", "**/[!d]?/*7.txt", "src{4,5}/de/?[0-4]*")
    return select_paths(views.files(spark, sf_dir), patterns).select("path")


@query
def glob_ignore(spark, sf_dir):
    patterns = ("**/fr/**", "*9.txt", "src{2,3}/*", "src1/")
    return select_paths(views.files(spark, sf_dir), ignore=patterns).select("path")


@query
def rule_precedence(spark, sf_dir):
    """The caller's includes replace those of the rule set, its ignores stay."""
    rules = effective_rules(include=["*/de/*"], rule_set=RULE_SETS[1])
    return select_paths(views.files(spark, sf_dir), rules.filters, rules.ignores).select("path")


GLOB_ENDINGS = ("*", "[", "{a,b", "[!a]", "**/*.txt", "[b-a]", "a]", "{x,y}?")


@query
def glob_validity(spark, sf_dir):
    """Which patterns, made of sources and endings, are globs at all."""
    documents = views.table(spark, sf_dir, "documents")
    endings = F.explode(F.array(*[F.lit(ending) for ending in GLOB_ENDINGS])).alias("ending")
    pattern = F.concat("source", F.lit("/"), "ending").alias("pattern")
    patterns = documents.select("source").distinct().select("source", endings).select(pattern)
    return patterns.withColumn("valid", is_glob(F.col("pattern")))


@query
def context_rules(spark, sf_dir):
    return select_by_rule_sets(views.files(spark, sf_dir).select("path"), RULE_SETS)


@query
def ignore_rules(spark, sf_dir):
    return drop_ignored(views.files(spark, sf_dir).select("path"), views.ignore_rules(spark))


@query
def ignore_chains(spark, sf_dir):
    """Hundreds of rules, most of them names of single files, in two directories of every source."""
    files = views.files(spark, sf_dir).select("path")
    return drop_ignored(files, compile_rules(views.many_rules(spark, sf_dir)))


# Ranking and reports


@query
def token_top_n(spark, sf_dir):
    return ranking.top_files(measured(spark, sf_dir))


@query
def token_order(spark, sf_dir):
    return ranking.by_tokens(counts(spark, sf_dir))


@query
def token_total(spark, sf_dir):
    return ranking.token_total(measured(spark, sf_dir))


@query
def widest_path(spark, sf_dir):
    return ranking.widest_path(views.web(spark, sf_dir))


@query
def token_report_plain(spark, sf_dir):
    return report_lines(measured(spark, sf_dir), 25)


@query
def token_report_json(spark, sf_dir):
    return report_json(measured(spark, sf_dir), 25)


# Hierarchy


def _listed(nodes):
    return nodes.select(F.array_join("node", "/").alias("path"), "name", "depth", "tokens")


@query
def tree_rollup(spark, sf_dir):
    return _listed(hierarchy.pre_order(hierarchy.rollup(counts(spark, sf_dir), unique=True)))


@query
def tree_rollup_web(spark, sf_dir):
    pages = apply_budgets(measure(views.web(spark, sf_dir)))
    return _listed(hierarchy.pre_order(hierarchy.rollup(pages, order_col="seq")))


@query
def tree_rollup_chat(spark, sf_dir):
    chat = apply_budgets(measure(views.chat(spark, sf_dir)))
    return _listed(hierarchy.pre_order(hierarchy.rollup(chat, unique=True)))


@query
def tree_last_children(spark, sf_dir):
    nodes = hierarchy.last_children(hierarchy.rollup(counts(spark, sf_dir), unique=True))
    return nodes.select(F.array_join("node", "/").alias("path"))


@query
def tree_lines(spark, sf_dir):
    lines = hierarchy.pre_order(hierarchy.tree_lines(counts(spark, sf_dir), unique=True))
    return lines.select(F.array_join("node", "/").alias("path"), "line")


@query
def tree_lines_web(spark, sf_dir):
    pages = apply_budgets(measure(views.web(spark, sf_dir)))
    lines = hierarchy.pre_order(hierarchy.tree_lines(pages, order_col="seq"))
    return lines.select(F.array_join("node", "/").alias("path"), "line")


@query
def tree_listed_repeats(spark, sf_dir):
    """The tree of a list with repeated lines: a path counts once, as it was last."""
    documents = views.table(spark, sf_dir, "documents")
    twice = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lines = documents.select(views.document_path().alias("value"), F.explode(twice).alias("time"))
    location = scratch_dir(spark)
    lines.orderBy("time", "value").select("value").write.text(location)
    found = lookup_paths(read_path_list(spark, location), views.files(spark, sf_dir))
    return _listed(hierarchy.pre_order(hierarchy.rollup(apply_budgets(measure(found)))))


# Merged output


@query
def merge_blocks(spark, sf_dir):
    return merge_files(views.files(spark, sf_dir), "text")


@query
def merge_json(spark, sf_dir):
    return merge_files(views.files(spark, sf_dir), "json")


@query
def merge_within_budget(spark, sf_dir):
    options = Options(min_tokens=100, max_tokens=400, limit_low=True, limit_high=True)
    return merge_files(views.files(spark, sf_dir), "text", options)


# Scalars


@query
def relative_paths(spark, sf_dir):
    path = F.col("path")
    return views.files(spark, sf_dir).select(path, scalar.relative_path(path, "src1").alias("inner"))


@query
def path_parts(spark, sf_dir):
    parts = scalar.path_components(F.concat(F.lit("/"), "path"))
    return views.web(spark, sf_dir).select(
        "seq",
        F.size(parts).cast("bigint").alias("parts"),
        parts[0].alias("first"),
        F.element_at(parts, -1).alias("last"),
    )


@query
def version_times(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    days = F.make_dt_interval((F.col("event_id") % 40 * 1000).cast("int"))
    # Times without a zone are UTC.
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts") - days)
    return events.select("event_id", scalar.version_seconds(instant).alias("mtime"))


@query
def source_megabytes(spark, sf_dir):
    size = F.sum(F.octet_length("text").cast("bigint")) * 37
    documents = views.table(spark, sf_dir, "documents")
    return documents.groupBy("source").agg(scalar.whole_mb(size).alias("mb"))


@query
def report_cells(spark, sf_dir):
    """Cells as wide as the widest path."""
    number = F.pow(F.lit(10), F.length("path") % 12).cast("bigint")
    pages = views.web(spark, sf_dir)
    width = ranking.widest_path(pages)
    return pages.select(
        "seq",
        scalar.left_cell(F.col("path"), width.scalar()).alias("cell"),
        scalar.right_cell(number).alias("number"),
    )


# Sources


@query
def decoded_bytes(spark, sf_dir):
    """Documents as bytes, some of them cut inside a character or missing."""
    documents = views.table(spark, sf_dir, "documents")
    raw = F.col("text").cast("binary")
    broken = F.concat(raw, F.unhex(F.lit("C3")))
    content = F.when(F.col("doc_id") % 7 == 0, broken).when(F.col("doc_id") % 11 != 0, raw)
    files = documents.select(views.document_path().alias("path"), content.alias("content"))
    return decode_utf8(files).select("path", F.length("content").alias("n_chars"), "error")


@query
def path_list_lookup(spark, sf_dir):
    """A written list: some documents, some of them twice, unknown paths and blank lines."""
    files = views.files(spark, sf_dir)
    ids = views.table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    path = views.document_path()
    extra = F.when(F.col("doc_id") % 2 == 0, path).otherwise(F.concat(path, F.lit(".bak ")))
    lines = ids.select(F.explode(F.array(path, extra, F.lit(" \t"), F.lit(""))).alias("value"))
    location = scratch_dir(spark)
    lines.write.text(location)
    found = lookup_paths(read_path_list(spark, location), files)
    return found.select("path", F.length("content").alias("n_chars"), "error")


def _write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("target").to_pylist(), batch.column("content").to_pylist())
        for target, content in rows:
            files, path = fs.FileSystem.from_uri(target)
            files.create_dir(os.path.dirname(path), recursive=True)
            with files.open_output_stream(path) as stream:
                stream.write(content)
        yield batch.select(["target"])


def _written_corpus(spark, sf_dir):
    """One file a document: German below a hidden folder, some invalid, some empty."""
    documents = views.table(spark, sf_dir, "documents")
    root = scratch_dir(spark)
    location = root if "://" in root else "file://" + root
    folder = F.when(F.col("lang") == "de", F.lit(".de")).otherwise(F.col("lang"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    raw = F.col("text").cast("binary")
    content = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.unhex(F.lit("FFFE")), raw))
        .when(F.col("doc_id") % 11 == 0, F.unhex(F.lit("")))
        .otherwise(raw)
    )
    target = F.concat_ws("/", F.lit(location), "source", folder, name).alias("target")
    rows = spread(documents.select(target, content.alias("content")))
    rows.mapInArrow(_write_files, "target string").write.format("noop").mode("overwrite").save()
    return root


@query
def file_tree_scan(spark, sf_dir):
    root = _written_corpus(spark, sf_dir)
    files = measure(decode_utf8(read_contents(list_files(spark, root))))
    path = scalar.relative_path(F.col("path"), root)
    return files.select(path.alias("path"), "length", "tokens", "error")


@query
def ignored_directories_not_listed(spark, sf_dir):
    """The directories that a walk over written files lists, with ignore files among them."""
    root = _written_corpus(spark, sf_dir)
    location = root if "://" in root else "file://" + root
    rules = spark.createDataFrame(list(views.WALK_FILES.items()), "place string, content string")
    rules = rules.select(F.concat(F.lit(location + "/"), "place").alias("target"), F.col("content").cast("binary").alias("content"))
    rules.mapInArrow(_write_files, "target string").write.format("noop").mode("overwrite").save()
    walk, levels = IgnoringWalk(spark, root, repositories_only=False), []

    def prune(entries):
        levels.append(materialise(walk.prune(entries).select("path")))
        return levels[-1]

    list_files(spark, root, prune=prune)
    listed = reduce(DataFrame.unionByName, levels)
    return listed.select(scalar.relative_path(F.col("path"), root).alias("path"))


@query
def visible_file_scan(spark, sf_dir):
    root = _written_corpus(spark, sf_dir)
    files = measure(decode_utf8(scan_visible_files(spark, root, min_length=1)))
    path = scalar.relative_path(F.col("path"), root)
    return files.select(path.alias("path"), "length", "tokens", "error")


# Result store


@query
def store_hits(spark, sf_dir):
    wanted = views.requests(spark, sf_dir).select("pos", "path", "mtime")
    hits = store.lookup_hits(wanted, views.stored(spark, sf_dir))
    return hits.select("path", "tokens", "mtime", "seq")


@query
def store_hits_exact(spark, sf_dir):
    wanted = views.requests(spark, sf_dir).select("pos", "path", "mtime")
    hits = store.lookup_hits(wanted, views.stored(spark, sf_dir), exact=True)
    return hits.select("path", "tokens", "mtime", "seq")


@query
def store_bucketed_hits(spark, sf_dir):
    """Every document asked for, from the buckets of a clustered store that may hold it."""
    results = ClusteredStore.create(spark, scratch_dir(spark))
    for seq in (1, 2):
        results.append(views.stored(spark, sf_dir).where(F.col("seq") == seq), seq=seq)
    wanted = views.requests(spark, sf_dir).select("pos", "path", "mtime")
    hits = results.hits(materialise(results.met(wanted, before=3)), before=3)
    return hits.select("path", "tokens", "mtime", "seq", F.length("content").alias("n_chars"))


@query
def store_misses(spark, sf_dir):
    misses = store.lookup_misses(views.requests(spark, sf_dir), views.stored(spark, sf_dir))
    return misses.select("path", "mtime", F.length("content").alias("n_chars"))


@query
def store_upsert_latest(spark, sf_dir):
    rows = store.latest_rows(views.stored(spark, sf_dir))
    return rows.select("path", "tokens", "mtime", "seq")


def _filled_store(spark, sf_dir):
    results = ResultStore.create(spark, scratch_dir(spark))
    for seq in (1, 2):
        results.append(views.stored(spark, sf_dir).where(F.col("seq") == seq), seq=seq)
    return results


@query
def store_info(spark, sf_dir):
    """Records, and the allocated bytes and megabytes less what a listing of the files gives."""
    results = _filled_store(spark, sf_dir)
    visible = list_files(spark, results.location).where("path not rlike '/[._][^/]*$'")
    listed = visible.agg(F.sum("length").alias("listed"))
    allocated = F.col("allocated")
    return results.info().withColumn("listed", listed.scalar()).select(
        "records",
        (allocated - F.col("listed")).alias("bytes_apart"),
        (F.col("mb") - F.round(F.col("listed") / 1048576)).alias("mb_apart"),
        (allocated > F.col("records")).alias("filled"),
    )


@query
def store_compacted(spark, sf_dir):
    compacted = _filled_store(spark, sf_dir).compact(scratch_dir(spark))
    return compacted.log().select("path", "tokens", "mtime", "seq")


@query
def store_cleared(spark, sf_dir):
    """What a cleared store holds after one more write."""
    results = _filled_store(spark, sf_dir)
    results.clear()
    results.append(views.stored(spark, sf_dir).where("seq = 2"))
    return results.latest().select("path", "tokens", "mtime", "seq")


@query
def incremental_run(spark, sf_dir):
    """Every document asked for, every fifth twice; stored ones are not measured again."""
    wanted = views.requests(spark, sf_dir)
    twice = wanted.where("pos % 5 = 0").withColumn("pos", -F.col("pos") - 1)
    results = incremental.incremental_run(wanted.unionByName(twice), _filled_store(spark, sf_dir))
    return results.select("pos", "path", "tokens", F.length("content").alias("n_chars"))


@query
def incremental_rerun(spark, sf_dir):
    """Documents measured by the first and by the second of two equal runs."""
    wanted = views.requests(spark, sf_dir)
    results = _filled_store(spark, sf_dir)
    incremental.incremental_run(wanted, results, unique=True, seq=3)
    incremental.incremental_run(wanted, results, unique=True, seq=4)
    runs = spark.createDataFrame([(3,), (4,)], "seq bigint")
    measured_rows = results.log().groupBy("seq").agg(F.count("*").alias("n"))
    return runs.join(measured_rows, "seq", "left").select("seq", F.coalesce("n", F.lit(0)).alias("measured"))


@query
def store_null_paths(spark, sf_dir):
    """Latest rows, hits and misses where some paths are null: no path is a path like any other."""
    path = F.when(F.col("path").rlike("[02468][.]txt$"), F.col("path"))
    log = views.stored(spark, sf_dir).where("seq = 1").withColumn("path", path)
    last = log.where("path is null").agg(F.max("tokens").alias("tokens"))
    log = log.where("path is not null").unionByName(log.where("path is null").where(F.col("tokens") == last.scalar()))
    asked = views.requests(spark, sf_dir).withColumn("path", path).select("pos", "path", "mtime")
    few = asked.where("path is not null").unionByName(asked.where("path is null").withColumn("mtime", F.lit(0)))
    found = {
        "latest": store.latest_rows(log).select("path", "tokens"),
        "hit": store.lookup_hits(few, log).select("path", "tokens"),
        "miss": store.lookup_misses(few, log).select("path", F.lit(0).cast("bigint").alias("tokens")),
    }
    frames = [frame.select(F.lit(kind).alias("kind"), "path", "tokens") for kind, frame in found.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def single_file_scan(spark, sf_dir):
    """A scan whose root is a file gives that file."""
    documents = views.table(spark, sf_dir, "documents").orderBy("doc_id").limit(1)
    path = scratch_dir(spark) + "/only.txt"
    target = F.lit(path if "://" in path else "file://" + path).alias("target")
    rows = documents.select(target, F.col("text").cast("binary").alias("content"))
    rows.mapInArrow(_write_files, "target string").write.format("noop").mode("overwrite").save()
    files = measure(decode_utf8(read_contents(list_files(spark, path))))
    return files.select("length", "tokens", "error")


@query
def stream_incremental(spark, sf_dir):
    """Versions in several micro-batches into a filled store; some are late."""
    results = _filled_store(spark, sf_dir)
    versions = views.requests(spark, sf_dir).select("path", "content", "mtime", "pos")
    location = scratch_dir(spark)
    files = max(1, ceil(estimated_bytes(versions) / 3 / FILE_BYTES))  # of each of three batches
    versions.repartitionByRange(3 * files, "pos").drop("pos").write.parquet(location)
    stream = spark.readStream.schema(versions.drop("pos").schema).option("maxFilesPerTrigger", files)
    start_incremental(stream.parquet(location), results, checkpoint=scratch_dir(spark)).awaitTermination()
    return results.latest().select("path", "tokens", "mtime")
