"""From hit lists to ranked, capped, cited and logged answers' context, for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.models import Scorer, pair_score
from chronotext.functions.text import (case_category, format_timestamp, is_refusal, normalize_punct, parse_timestamp, strip,
                                       strip_echoed_question, title_case)
from chronotext.functions.tokens import lexical_terms, term_overlap


def rank_hits(hits: DataFrame, query: str = "query_id", item: str = "chunk_id",
              score: str = "similarity") -> DataFrame:
    """Position of each hit in its query's list, ties by id."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item))
    return hits.withColumn("rank", F.row_number().over(w))


def merge_results(lists: Sequence[DataFrame]) -> DataFrame:
    """Union of hit lists, each chunk once per query with its highest similarity."""
    union = None
    for hits in lists:
        one = hits.select("query_id", "chunk_id", "similarity")
        union = one if union is None else union.unionByName(one)
    return union.groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"))


def rank_fusion(lists: Sequence[tuple[DataFrame, float]], k: int = 60, carry: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, similarity, rank), one weight per list.

    Equal scores keep the order in which the lists, and the hits in them, come.
    """
    union = None
    for place, (hits, weight) in enumerate(lists):
        one = hits.select(
            "query_id", "chunk_id", "similarity", *carry,
            (F.lit(float(weight)) / (k + F.col("rank"))).alias("_part"),
            F.struct(F.lit(place).alias("list"), F.col("rank").alias("rank")).alias("_seen"))
        union = one if union is None else union.unionByName(one)
    fused = union.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("_part"), 12).alias("rrf_score"),
        F.max("similarity").alias("similarity"),
        F.min("_seen").alias("_seen"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry])
    w = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("_seen"), F.col("chunk_id"))
    return fused.withColumn("position", F.row_number().over(w)).drop("_seen")


def cap_per_video(candidates: DataFrame, video: str, position: str = "rank", per_video: int = 2,
                  k: int = 5) -> DataFrame:
    """At most ``per_video`` hits per video, refilled when fewer than ``2 k`` remain, then the k most similar.

    ``candidates`` is a bounded list per query. The refill appends the hits that were capped; the final order is by
    similarity, ties in pool order.
    """
    in_video = Window.partitionBy("query_id", video).orderBy(position)
    per_query = Window.partitionBy("query_id")
    marked = candidates.withColumn("_kept", F.row_number().over(in_video) <= per_video)
    marked = marked.withColumn("_pool", F.sum(F.col("_kept").cast("int")).over(per_query))
    pool = marked.where(F.col("_kept") | (F.col("_pool") < 2 * k))
    order = Window.partitionBy("query_id").orderBy(
        F.col("similarity").desc(), F.col("_kept").desc(), F.col(position))
    return pool.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k).drop(
        "_kept", "_pool")


def rerank(pairs: DataFrame, k: int = 4, model: Callable[[], Scorer] | None = None, query: str = "query",
           passage: str = "clean_text", order: str = "rank") -> DataFrame:
    """Re-score each query's candidates and keep the best k; equal scores keep their order.

    A lone candidate keeps its similarity. Without a model the score is the share of query terms in the passage.
    """
    score = (term_overlap(lexical_terms(F.col(query)), lexical_terms(F.coalesce(F.col(passage), F.lit(""))))
             if model is None else pair_score(F.col(query), F.col(passage), model))
    scored = pairs.withColumn("_score", score).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    scored = scored.withColumn("cross_encoder_score", F.when(
        F.col("_n") == 1, F.coalesce(F.col("similarity"), F.lit(1.0))).otherwise(F.col("_score")))
    w = Window.partitionBy("query_id").orderBy(F.col("cross_encoder_score").desc(), F.col(order))
    return scored.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= k).drop(
        "_score", "_n")


def enrich_channel(df: DataFrame, channels: DataFrame, channel: str = "channel_id") -> DataFrame:
    """Channel title, or the key made readable where the dimension lacks it."""
    titles = channels.select(F.col("id").alias(channel), F.col("title").alias("_title"))
    return df.join(titles, channel, "left").withColumn(
        "channel_title", F.coalesce(F.col("_title"), title_case(F.col(channel)))).drop("_title")


def deep_link(video: Column, seconds: Column, host: str = "https://youtu.be/") -> Column:
    return F.concat(F.lit(host), video.cast("string"), F.lit("?t="), seconds.cast("string"))


def make_citations(hits: DataFrame, title_prefix: str = "Recording", excerpt: int = 280) -> DataFrame:
    """Link, label, excerpt and rounded score per hit.

    Needs video_id, channel_title, start_sec, end_sec, clean_text, similarity and title (may be null).
    """
    vid, text = F.col("video_id").cast("string"), F.coalesce(F.col("clean_text"), F.lit(""))
    start = format_timestamp(F.col("start_sec"))
    return hits.withColumns({
        "title": F.coalesce(F.when(F.col("title") != "", F.col("title")),
                            F.concat(F.lit(title_prefix + " ("), vid, F.lit(")"))),
        "timestamp_start": start,
        "timestamp_end": format_timestamp(F.col("end_sec")),
        "url": deep_link(vid, F.col("start_sec")),
        "label": F.concat(F.lit("["), F.col("channel_title"), F.lit(" • "), start, F.lit("]")),
        "relevance_score": F.round("similarity", 3),
        "excerpt": F.concat(F.substring(text, 1, excerpt), F.when(F.length(text) > excerpt, "...").otherwise("")),
    })


def build_context(citations: DataFrame, rank: str = "final_rank") -> DataFrame:
    """One numbered context text per query, from its top-k citations."""
    block = F.concat(
        F.lit("--- Passage "), F.col(rank).cast("string"), F.lit(" ["), F.col("channel_title"), F.lit("] ---\n"),
        F.lit("Video: "), F.col("video_id").cast("string"), F.lit(" | "), F.col("title"), F.lit("\n"),
        F.lit("Time: "), F.col("timestamp_start"), F.lit(" - "), F.col("timestamp_end"), F.lit("\n"),
        F.lit("Link: "), F.col("label"), F.lit("("), F.col("url"), F.lit(")\n"),
        F.coalesce(F.col("clean_text"), F.lit("")), F.lit("\n"))
    packed = citations.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("_p"))
    return packed.select("query_id", F.array_join(F.transform("_p", lambda x: x["b"]), "\n").alias("context"),
                         F.size("_p").alias("n_passages"))


def log_rows(citations: DataFrame, rank: str = "final_rank") -> DataFrame:
    """One telemetry row per query: chunk ids, video ids, distinct channels and scores, in rank order."""
    entry = F.struct(F.col(rank).alias("r"), F.col("chunk_id").cast("string").alias("c"),
                     F.col("video_id").cast("string").alias("v"), F.round("similarity", 3).alias("s"))
    packed = citations.groupBy("query_id").agg(
        F.array_sort(F.collect_list(entry)).alias("_p"),
        F.sort_array(F.collect_set(F.col("channel_id").cast("string"))).alias("source_channels_retrieved"))
    pick = lambda name: F.transform("_p", lambda x: x[name])
    return packed.select("query_id", pick("c").alias("retrieved_chunk_ids"), pick("v").alias("retrieved_video_ids"),
                         "source_channels_retrieved", pick("s").alias("rerank_scores"))


# A bracketed or parenthesised mention of a time that is not a link yet.
BRACKET_MENTION = r"(?U)[\[(][^\])\r\n]+?\d{1,2}:\d{2}(?::\d{2})?[^\])\r\n]*?[\])](?!\s*\()"
_TIME = r"(?U)(\d{1,2}:\d{2}(?::\d{2})?)"


def bold_mention(first_words: Sequence[str]) -> str:
    """A bold mention that starts with a channel's first word and holds a time."""
    starts = "|".join(first_words)
    return rf"(?iU)\*\*(?:{starts})[^*\r\n]+?\d{{1,2}}:\d{{2}}(?::\d{{2}})?[^*\r\n]*?\*\*(?!\s*\()"


def mentions_of(answers: DataFrame, pattern: str, margin: int, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """Every time mention of an answer with its seconds and channel; ``margin`` is the length of its brackets."""
    # outer, so that Spark does not search every text again to filter on the number of hits
    found = answers.select("answer_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(
        0))).alias("pos", "mention")).where(F.col("mention").isNotNull())
    inner = F.substring("mention", F.lit(margin + 1), F.length("mention") - 2 * margin)
    norm = strip(normalize_punct(inner))
    tail = F.when(norm.rlike(r"[.,;:!]\z"), F.substring(norm, -1, 1)).otherwise("")
    body = F.when(tail != "", strip(F.substring(norm, F.lit(1), F.length(norm) - 1))).otherwise(norm)
    low = F.lower(body)
    shown = strip(inner)
    shown = F.when(shown.rlike(r"[.,;:!]\z"), strip(F.substring(shown, F.lit(1), F.length(shown) - 1))).otherwise(
        shown)
    return found.select(
        "answer_id", "pos", "mention", shown.alias("shown"), tail.alias("tail"),
        parse_timestamp(F.regexp_extract(body, _TIME, 1)).alias("seconds"),
        F.coalesce(*[F.when(low.contains(a), F.lit(ch)) for a, ch in aliases], F.lit(None).cast("string")).alias(
            "channel"))


def nearest_citation(mentions: DataFrame, citations: DataFrame) -> DataFrame:
    """Per mention the citation of the same answer closest in time, first within the mentioned channel.

    ``citations``: answer_id, cit_pos, channel_id, video_id, start_sec. Earlier citations win ties.
    """
    c = citations.select("answer_id", "cit_pos", "channel_id", "video_id", "start_sec")
    # an answer has at most k citations, so a mention meets at most k rows
    joined = mentions.join(c, "answer_id")
    cost = F.struct(
        F.coalesce((F.col("channel") != F.col("channel_id")).cast("int"), F.lit(1)).alias("other_channel"),
        F.abs(F.coalesce(F.col("start_sec"), F.lit(0)) - F.col("seconds")).alias("distance"),
        F.col("cit_pos").alias("cit_pos"))
    keys = ["answer_id", "pos", "mention", "shown", "tail", "seconds", "channel"]
    best = joined.groupBy(*keys).agg(
        F.min_by(F.struct("video_id", "channel_id"), cost).alias("b"))
    return best.select(*keys, F.col("b.video_id").alias("video_id"), F.col("b.channel_id").alias("cited_channel"),
                       deep_link(F.col("b.video_id"), F.col("seconds")).alias("url"))


def _link_pass(answers: DataFrame, citations: DataFrame, pattern: str, margin: int, wrap: str,
               aliases: Sequence[tuple[str, str]]) -> DataFrame:
    links = nearest_citation(mentions_of(answers, pattern, margin, aliases), citations)
    link = F.concat(F.lit(wrap + "["), F.col("shown"), F.lit("]("), F.col("url"), F.lit(")"), F.col("tail"),
                    F.lit(wrap))
    # a mention whose time can't be read stays as it stands
    packed = links.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "pos", F.coalesce(link, F.col("mention")).alias("l")))), lambda x: x["l"]).alias("_l"))
    pieces = F.split("text", pattern, -1)
    woven = F.array_join(F.zip_with(pieces, F.col("_l"), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return answers.join(packed, "answer_id", "left").withColumn(
        "text", F.when(F.col("_l").isNull(), F.col("text")).otherwise(woven)).drop("_l")


def resolve_citations(answers: DataFrame, citations: DataFrame, aliases: Sequence[tuple[str, str]],
                      bold_words: Sequence[str] = ()) -> DataFrame:
    """Turn time mentions in ``answers(answer_id, text)`` into links to the nearest citation."""
    out = _link_pass(answers, citations, BRACKET_MENTION, 1, "", aliases)
    if bold_words:
        out = _link_pass(out, citations, bold_mention(bold_words), 2, "**", aliases)
    return out


def finish_answers(answers: DataFrame, citations: DataFrame, aliases: Sequence[tuple[str, str]],
                   bold_words: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final answers, their citations, and telemetry, from raw ``answers(query_id, text)`` and ranked citations.

    An answer is cleaned of a repeated question; a refusal loses its citations and counts as not answered, any other
    gets its time mentions linked. Returns (query_id, answer, answered), the citations that stay, and one log row per
    answer with empty lists where there are none.
    """
    clean = answers.select("query_id", strip_echoed_question(F.col("text")).alias("text"))
    marked = clean.withColumn("answered", F.coalesce(~is_refusal(F.col("text")), F.lit(False)))
    kept = citations.join(marked.where("answered").select("query_id"), "query_id", "left_semi")
    linked = resolve_citations(
        marked.where("answered").select(F.col("query_id").alias("answer_id"), "text"),
        kept.select(F.col("query_id").alias("answer_id"), F.col("final_rank").alias("cit_pos"), "channel_id", "video_id",
                    "start_sec"), aliases, bold_words)
    final = marked.select("query_id", F.col("text").alias("_raw"), "answered").join(
        linked.select(F.col("answer_id").alias("query_id"), F.col("text").alias("_linked")), "query_id", "left").select(
        "query_id", F.coalesce("_linked", "_raw").alias("answer"), "answered")
    log = marked.select("query_id", "answered").join(log_rows(kept), "query_id", "left")
    lists = [c for c in log.columns if c not in ("query_id", "answered")]
    return final, kept, log.withColumns({
        c: F.coalesce(F.col(c), F.array().cast(log.schema[c].dataType)) for c in lists})


def classify_cases(df: DataFrame, text: str, taxonomy: Sequence[tuple]) -> DataFrame:
    """Category of each text with its title and principles; the taxonomy table is as short as its definition."""
    spark = df.sparkSession
    table = spark.createDataFrame([(t[0], t[1], list(t[3]), t[4]) for t in taxonomy],
                                  "case_category string, case_title string, principles array<string>, "
                                  "expansion string")
    return df.withColumn("case_category", case_category(F.col(text), taxonomy)).join(
        F.broadcast(table), "case_category", "left")
