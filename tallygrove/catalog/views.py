"""The shared tables as files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.pieces import pieces
from tallygrove.operators.ignore_rules import parse_ignore_files
from tallygrove.session import materialise
from tallygrove.sources.corpus import corpus_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path():
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source/lang/id.txt."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return corpus_files(table(spark, sf_dir, "documents"), ["source", "lang", name], "text")


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, seq) of pages by address: paths repeat, some are also directories."""
    address = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        address.alias("path"), F.col("html").alias("content"), F.col("page_id").alias("seq")
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as id/turn-role.txt."""
    conversation = F.col("conv_id").cast("string")
    turn = F.concat(F.col("turn").cast("string"), F.lit("-"), "role", F.lit(".txt"))
    return corpus_files(table(spark, sf_dir, "conversations"), [conversation, turn], "text")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, path, content, mtime): documents asked for at a version."""
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        F.col("doc_id").alias("pos"),
        document_path().alias("path"),
        F.col("text").alias("content"),
        (F.lit(1000) + F.col("doc_id") % 4).alias("mtime"),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store log of two thirds of the documents, in two writes.

    Its token numbers cannot be real ones, so an answer tells where it came from.
    """
    documents = table(spark, sf_dir, "documents")
    first = documents.where("doc_id % 3 <> 0").select(
        document_path().alias("path"),
        F.col("text").alias("content"),
        (F.lit(1_000_000) + F.col("doc_id")).alias("tokens"),
        (F.lit(1000) + F.col("doc_id") % 5).alias("mtime"),
        F.lit(None).cast("string").alias("error"),
        F.lit(1).cast("bigint").alias("seq"),
    )
    again = (
        first.where("tokens % 4 = 0")
        .withColumn("tokens", F.col("tokens") + 1_000_000)
        .withColumn("mtime", F.lit(1001).cast("bigint"))
        .withColumn("seq", F.lit(2).cast("bigint"))
    )
    return first.unionByName(again)


def stand_in_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary from the benchmark texts: all bytes, and all their 2- and 3-byte runs.

    The rank is the value of the bytes, shorter ones first.
    """
    one = spark.range(256).select(
        F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"), F.col("id").cast("int").alias("rank")
    )
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(pieces(F.col("text"))).alias("piece")
    )
    sizes = F.explode(F.array(F.lit(2), F.lit(3))).alias("size")
    runs = (
        words.distinct()
        .select(F.col("piece").cast("binary").alias("bytes"), sizes)
        .where(F.octet_length("bytes") >= F.col("size"))
        .select(
            "bytes", "size", F.explode(F.expr("sequence(1, octet_length(bytes) - size + 1)")).alias("at")
        )
        .select(F.expr("substring(bytes, at, size)").alias("token"))
        .distinct()
    )
    value = F.conv(F.hex("token"), 16, 10).cast("int")
    shift = F.when(F.octet_length("token") == 2, F.lit(256)).otherwise(F.lit(65792))
    return materialise(one.unionByName(runs.select("token", (shift + value).alias("rank"))))


# Ignore files of the `ignore_rules` query, by path.
IGNORE_FILES = {
    ".gitignore": "# odd ones\n*7.txt\n!*77.txt\nfr/\n/src3\n\nsrc1?/de/**\n**/es/*5.txt\r\n",
    "src5/.gitignore": "*.txt\n!en/\n!/en/*2.txt\n",
    "src2/.gitignore": "en/*\n!en/*[1-4].txt\n",
    "src4/en/.gitignore": "/*0.txt\n!*00.txt  \n",
    "src6/.ignore": "!*7.txt\n*8.txt\n",
}


def ignore_rules(spark: SparkSession) -> DataFrame:
    return parse_ignore_files(
        spark.createDataFrame(list(IGNORE_FILES.items()), "path string, content string")
    )


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base, level, line, value): in every source a line for each fifth document, as a name, an
    ending, a beginning or a path; on top of them, in a stronger file, one that takes back a tenth."""
    documents = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 20
    value = (
        F.when(kind == 0, F.concat(name, F.lit(".txt")))
        .when(kind == 5, F.concat(F.lit("*"), F.substring(name, -3, 3), F.lit(".txt")))
        .when(kind == 10, F.concat(F.substring(name, 1, 3), F.lit("*")))
        .otherwise(F.concat(F.lit("/"), "lang", F.lit("/"), name, F.lit(".txt")))
    )
    own = documents.where("doc_id % 5 = 0").select(
        F.col("source").alias("base"), F.lit(1).alias("level"), F.col("doc_id").cast("int").alias("line"), value.alias("value")
    )
    top = documents.where("doc_id % 10 = 0").select(
        F.lit("").alias("base"), F.lit(2).alias("level"), F.col("doc_id").cast("int").alias("line"),
        F.concat(F.lit("!"), name, F.when(F.col("doc_id") % 500 == 0, F.lit(".t?t")).otherwise(F.lit(".txt"))).alias("value"),
    )
    return own.unionByName(top)


# Ignore files of the written corpus, for the walk over it.
WALK_FILES = {
    "src1/.gitignore": "fr/\n.de\n!.de/\n",
    "src2/.gitignore": "*\n",
    "src3/.ignore": "/e*\n!es\n",
    ".gitignore": "src4/\n",
    "src4/.gitignore": "!*\n",
}
