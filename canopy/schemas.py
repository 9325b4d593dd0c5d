"""Fixed schemas of every table the library reads or writes (never inferred)."""

from pyspark.sql import types as T

# One function / class entry of a structured summary.
ITEM = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("loc", T.IntegerType()),
    T.StructField("summary", T.StringType()),
])

# Structured summary of one chunk or one file.
SUMMARY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("functions", T.ArrayType(ITEM)),
    T.StructField("classes", T.ArrayType(ITEM)),
    T.StructField("loc", T.IntegerType()),
])

FILES = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("size", T.LongType()),
])

SUMMARIES = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("summary", SUMMARY),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

DIRECTORIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("loc", T.LongType()),
    T.StructField("file_count", T.LongType()),
])

TOPICS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("is_root", T.BooleanType()),
])

TOPIC_LINKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("topic_id", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("confidence", T.IntegerType()),
])

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

EMBEDDINGS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("vector", VECTOR),
    T.StructField("batch", T.LongType()),
])

CONTEXT = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("path", T.StringType()),         # files and chunks
    T.StructField("loc", T.IntegerType()),         # of the file, or of the chunk alone
    T.StructField("parent", T.StringType()),       # a topic's parent id, a chunk's file title
    T.StructField("depth", T.IntegerType()),       # topics
    T.StructField("chunk_kind", T.StringType()),   # chunks: func or class
    T.StructField("n_functions", T.IntegerType()),  # files
    T.StructField("n_classes", T.IntegerType()),
])
