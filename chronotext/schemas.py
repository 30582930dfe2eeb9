"""Schemas of the catalog tables. Readers use these; nothing is inferred."""

from pyspark.sql import types as T

ALIAS = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("video_title", T.StringType()),
    T.StructField("timestamp_sec", T.IntegerType()),
    T.StructField("timestamp_formatted", T.StringType()),
])

CHANNELS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("handle", T.StringType()),
    T.StructField("external_channel_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("last_synced_at", T.TimestampType()),
    T.StructField("video_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
])

VIDEOS = T.StructType([
    T.StructField("video_id", T.StringType(), False),
    T.StructField("channel_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("upload_date", T.DateType()),
    T.StructField("duration_seconds", T.IntegerType()),
    T.StructField("view_count", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("transcript_language", T.StringType()),
    T.StructField("transcription_model", T.StringType()),
    T.StructField("is_duplicate", T.BooleanType()),
    T.StructField("canonical_video_id", T.StringType()),
    T.StructField("dedup_similarity_score", T.DoubleType()),
    T.StructField("indexed_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
])

SEGMENT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
])

TRANSCRIPTS = T.StructType([
    T.StructField("video_id", T.StringType(), False),
    T.StructField("channel_id", T.StringType()),
    T.StructField("segments", T.ArrayType(SEGMENT)),
])

CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("video_id", T.StringType()),
    T.StructField("channel_id", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("start_sec", T.IntegerType()),
    T.StructField("end_sec", T.IntegerType()),
    T.StructField("start_formatted", T.StringType()),
    T.StructField("end_formatted", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("is_duplicate", T.BooleanType()),
    T.StructField("canonical_chunk_id", T.StringType()),
    T.StructField("canonical_video_id", T.StringType()),
    T.StructField("cross_channel_aliases", T.ArrayType(ALIAS)),
    T.StructField("created_at", T.TimestampType()),
])

QUERY_LOGS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("raw_query", T.StringType()),
    T.StructField("normalized_query", T.StringType()),
    T.StructField("rewritten_query", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("retrieved_chunk_ids", T.ArrayType(T.StringType())),
    T.StructField("source_channels_retrieved", T.ArrayType(T.StringType())),
    T.StructField("rerank_scores", T.ArrayType(T.DoubleType())),
    T.StructField("latency_ms", T.IntegerType()),
    T.StructField("llm_provider", T.StringType()),
    T.StructField("llm_model", T.StringType()),
    T.StructField("answered", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

FEEDBACK = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("query", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("flagged", T.BooleanType()),
    T.StructField("note", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

SYNC_STATUS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("channel_id", T.StringType()),
    T.StructField("last_sync_started_at", T.TimestampType()),
    T.StructField("last_sync_completed_at", T.TimestampType()),
    T.StructField("videos_found", T.IntegerType()),
    T.StructField("videos_ingested", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

GOLDEN_SET = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("expected_channel", T.StringType()),
    T.StructField("expected_topic", T.StringType()),
    T.StructField("expected_answer_contains", T.ArrayType(T.StringType())),
    T.StructField("should_refuse", T.BooleanType()),
    T.StructField("context_history", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
])

CATALOG = {
    "channels": CHANNELS,
    "videos": VIDEOS,
    "transcript_chunks": CHUNKS,
    "query_logs": QUERY_LOGS,
    "feedback": FEEDBACK,
    "sync_status": SYNC_STATUS,
}
