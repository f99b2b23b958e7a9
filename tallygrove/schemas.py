"""Row shapes shared by the operators."""

from pyspark.sql import types as T

LISTING = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("mtime", T.LongType(), False),
])

# One measured file. `error` is set only when the content could not be read.
MEASURED = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("tokens", T.LongType(), False),
    T.StructField("error", T.StringType(), True),
])

# One row of the result store as written; `seq` is the directory of the write.
STORED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tokens", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("seq", T.LongType()),
])

IGNORE_RULES = T.StructType([
    T.StructField("base", T.StringType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("line", T.IntegerType(), False),
    T.StructField("neg", T.BooleanType(), False),
    T.StructField("dironly", T.BooleanType(), False),
    T.StructField("rx", T.StringType(), False),
])

VOCAB = T.StructType([
    T.StructField("token", T.BinaryType(), False),
    T.StructField("rank", T.IntegerType(), False),
])

RULE_SET_FILE = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("contexts", T.ArrayType(T.StructType([
        T.StructField("context", T.StringType()),
        T.StructField("filters", T.ArrayType(T.StringType())),
        T.StructField("ignores", T.ArrayType(T.StringType())),
    ]))),
])
