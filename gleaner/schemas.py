"""Fixed schemas at every boundary (never inferred)."""

from pyspark.sql import types as T

WIRE = T.StructType([
    T.StructField("subreddit", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("is_video", T.BooleanType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("domain", T.StringType()),
    T.StructField("flair", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("feed_rank", T.IntegerType()),
    T.StructField("metrics_available", T.BooleanType()),
])

# One scanned item, whatever the adapter. ``seq`` orders rows the way the
# adapters would have emitted them (adapter order, source ordinal, position).
RAW_ITEM = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("adapter", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("published_date", T.DateType()),
    T.StructField("author", T.StringType()),
    T.StructField("raw_tags", T.ArrayType(T.StringType())),
    T.StructField("wire", WIRE),
])

# A feed entry as landed (RSS item / Atom entry flattened to strings).
FEED_ENTRY = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("feed_ord", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
])

TRIAGE = T.StructType([
    T.StructField("reaction_worthiness", T.IntegerType()),
    T.StructField("best_lens", T.StringType()),
    T.StructField("why", T.StringType()),
    T.StructField("error", T.StringType()),
])

LENS = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("first_sentence", T.StringType()),
])

META = T.StructType([
    T.StructField("note_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("publication", T.StringType()),
    T.StructField("publication_date", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("entities", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("claims", T.ArrayType(T.StringType())),
    T.StructField("relevance", T.ArrayType(T.StringType())),
    T.StructField("time_sensitivity", T.StringType()),
])

QUARANTINE = T.StructType([
    T.StructField("source_url", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("payload", T.StringType()),
])

# Model call result columns appended by operators.infer.infer_batch.
INFER_OUT = [
    T.StructField("reply", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("error", T.StringType()),
]
