"""Sources, projections and predicates on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext import fixed_values as fixed
from chronotext import schemas
from chronotext.functions import text as tx
from chronotext.operators import lexicon, retrieval
from chronotext.registry.base import WORDS_SQL, Registry, clock_sql, documents, table, upload_date
from chronotext.session import new_dir
from chronotext.sources import feeds, golden, segments, tables

R = Registry()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


# ---- sources and sinks

@R.add("read_tables", " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES))
def read_tables(spark, sf):
    out = None
    for t in TABLES:
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("read_catalog", """
select source as channel_id, count(*) as n_videos, sum(n_chars) as views, max(n_chars % 5000) as longest,
  min(case when doc_id % 17 <> 0 then date '2023-01-01' + cast(doc_id % 365 as integer) end) as first_upload,
  count(*) filter (where doc_id % 3 = 0) as duplicates, round(sum(case when doc_id % 3 = 0 then doc_id / 8.0 end), 3) as scores
from documents group by source""")
def read_catalog(spark, sf):
    """The catalog's table of videos, stored and read with its fixed schema, with an aggregate of each type."""
    doc = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        doc.cast("string").alias("video_id"), F.col("source").alias("channel_id"), F.col("text").alias("description"),
        upload_date(doc).alias("upload_date"), F.col("n_chars").cast("long").alias("view_count"),
        (F.col("n_chars") % 5000).cast("int").alias("duration_seconds"), (doc % 3 == 0).alias("is_duplicate"),
        F.when(doc % 3 == 0, doc / 8).alias("dedup_similarity_score"))
    schema, root = schemas.CATALOG["videos"], new_dir(spark, "catalog")
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                  for f in schema]).write.parquet(f"{root}/videos")
    return tables.read_catalog(spark, root, "videos").groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_videos"), F.sum("view_count").alias("views"),
        F.max("duration_seconds").alias("longest"), F.min("upload_date").alias("first_upload"),
        F.count_if("is_duplicate").alias("duplicates"), F.round(F.sum("dedup_similarity_score"), 3).alias("scores"))


@R.add("parse_feed", """
select cast(o_orderkey as varchar) as video_id, 'Order ' || o_custkey as title,
       'https://www.youtube.com/watch?v=' || o_orderkey as url,
       case when o_orderpriority <> '5-LOW' then cast(o_orderdate as date) end as upload_date,
       case when o_orderstatus = 'P' then 0 else cast(floor(o_totalprice) as bigint) end as duration_seconds,
       case when o_orderstatus = 'O' then 0 else o_custkey end as view_count
from orders""")
def parse_feed(spark, sf):
    o = table(spark, sf, "orders")
    lines = o.select(F.concat_ws(
        "\t", F.col("o_orderkey").cast("string"), F.concat(F.lit("Order "), F.col("o_custkey")),
        F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise(F.date_format("o_orderdate", "yyyyMMdd")),
        F.when(F.col("o_orderstatus") == "P", "NA").otherwise(
            F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5"))),
        F.when(F.col("o_orderstatus") == "O", "n/a").otherwise(F.col("o_custkey").cast("string"))).alias("value"))
    return feeds.parse_feed(lines)


@R.add("read_segments", f"""
with w as (select doc_id, {WORDS_SQL} as ws from documents)
select doc_id as video_id, cast(ceil(len(ws) / 20.0) as bigint) as n_segments,
       cast(10 * ceil(len(ws) / 20.0) as double) as last_end, array_to_string(ws, ' ') as full_text
from w where len(ws) > 0""")
def read_segments(spark, sf):
    d = documents(spark, sf)
    made = d.select("doc_id", segments.segments_from_text(F.col("text")).alias("s"))
    # through the text form, with the end left out, as caption files come
    as_json = made.select("doc_id", F.to_json(F.transform("s", lambda x: F.struct(
        x["text"].alias("text"), x["start"].alias("start"), x["duration"].alias("duration")))).alias("j"))
    read = as_json.select("doc_id", segments.fill_segments(F.from_json(
        "j", schemas.TRANSCRIPTS["segments"].dataType)).alias("segments")).where(F.size("segments") > 0)
    return read.select(
        F.col("doc_id").alias("video_id"), F.size("segments").cast("bigint").alias("n_segments"),
        F.element_at("segments", -1)["end"].alias("last_end"),
        segments.full_text(F.col("segments")).alias("full_text"))


@R.add("tier_coalesce", f"""
with w as (select d.doc_id, lang, len({WORDS_SQL}) as n, l.quality from documents d left join labels l using (doc_id))
select doc_id as video_id,
       case when quality = 1 then 'captions' when lang = 'en' then 'cloud' else 'local' end as tier,
       cast(case when quality = 1 then ceil(n / 20.0) when lang = 'en' then ceil(n / 30.0) else ceil(n / 40.0) end
            as bigint) as n_segments
from w where n > 0 and (quality = 1 or lang in ('en', 'fr', 'de'))""")
def tier_coalesce(spark, sf):
    d = documents(spark, sf)
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    seg = lambda df, n: df.select(F.col("doc_id").alias("video_id"), segments.segments_from_text(
        F.col("text"), n).alias("segments"))
    chosen = segments.first_available([
        ("captions", seg(d.join(good, "doc_id", "left_semi"), 20)),
        ("cloud", seg(d.where("lang = 'en'"), 30)),
        ("local", seg(d.where("lang in ('en', 'fr', 'de')"), 40)),
    ])
    return chosen.select("video_id", "tier", F.size("segments").cast("bigint").alias("n_segments"))


_UPDATES_SQL = """
u as (select l_partkey * 10 as k, l_extendedprice as price, l_returnflag as tag from lineitem
      qualify row_number() over (partition by l_partkey
        order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_quantity desc) = 1),
t as (select o_orderkey as k, o_totalprice as price, o_orderstatus as tag from orders)"""


def _upsert_sides(spark, sf):
    t = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("tag"))
    u = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") * 10).alias("k"), F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("tag"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    version = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "price", "l_quantity")]
    return t, tables.latest(u, ["k"], version).select("k", "price", "tag")


@R.add("upsert", f"""with {_UPDATES_SQL}
select * from u union all select * from t where k not in (select k from u)""")
def upsert(spark, sf):
    t, u = _upsert_sides(spark, sf)
    return tables.upsert(t, u, ["k"], [F.col("price")])


@R.add("upsert_ignore_existing", f"""with {_UPDATES_SQL}
select * from t union all select * from u where k not in (select k from t)""")
def upsert_ignore_existing(spark, sf):
    t, u = _upsert_sides(spark, sf)
    return tables.upsert(t, u, ["k"], [F.col("price")], ignore_existing=True)


def _golden_rows(spark, sf):
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    ws = tx.words(F.col("text"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"),
        F.when(F.col("quality") == 1, "clean").otherwise("noisy").alias("query_type"),
        F.col("source").alias("expected_channel"), F.col("lang").alias("expected_topic"),
        F.slice(ws, 1, 2).alias("expected_answer_contains"), (F.col("toxic") == 1).alias("should_refuse"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("context_history"))


@R.add("read_golden", f"""
select cast(doc_id as varchar) as id, text as question, case when quality = 1 then 'clean' else 'noisy' end as query_type,
       source as expected_channel, toxic = 1 as should_refuse,
       array_to_string(list_slice({WORDS_SQL}, 1, 2), '|') as expected, text as first_history
from documents join labels using (doc_id)""")
def read_golden(spark, sf):
    path = new_dir(spark, "golden")
    _golden_rows(spark, sf).write.json(path)
    g = golden.read_golden(spark, path, multi_line=False)
    return g.select("id", "question", "query_type", "expected_channel", "should_refuse",
                    F.array_join("expected_answer_contains", "|").alias("expected"),
                    F.get("context_history", F.lit(0))["content"].alias("first_history"))


# ---- projections, filters, predicates

_OVERRIDE_EXTRA, _TOPIC_EXTRA = [r"ing\s+the"], [r"\b(?:para|nicht|dans)\b"]
_UNI = r"(^|[^\pL\pN_])({})($|[^\pL\pN_])"
_OVER_SQL = "|".join(fixed.OVERRIDE_PATTERNS + _OVERRIDE_EXTRA)
_TOPIC_SQL = "|".join(fixed.OFF_TOPIC_PATTERNS + [_UNI.format("para|nicht|dans")])


@R.add("screen_queries", f"""
select conv_id, turn, case when length(trim(text)) < 2 then 'too_short'
       when regexp_matches(text, '(?i){_OVER_SQL}') then 'jailbreak'
       when regexp_matches(text, '(?i){_TOPIC_SQL}') then 'off_topic' end as reason
from conversations""")
def screen_queries(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.screen_reason(
        F.col("text"), fixed.OVERRIDE_PATTERNS + _OVERRIDE_EXTRA, fixed.OFF_TOPIC_PATTERNS + _TOPIC_EXTRA).alias(
            "reason"))


_TAXONOMY = [
    ("ACTION", "Doing", [r"ing\s+the", r"tionen"], ["act", "move"], "ing ed tion"),
    ("PLACE", "Where", [r"dans.*les", r"para\s+la"], ["here"], "dans para la les"),
    ("OTHER", "Rest", [r"und", r"qu[ei]"], ["misc", "else"], "und que qui"),
]


@R.add("classify_case", """
with c as (select conv_id, turn, case when regexp_matches(text, '(?i)ing\\s+the|tionen') then 'ACTION'
       when regexp_matches(text, '(?i)dans.*les|para\\s+la') then 'PLACE'
       when regexp_matches(text, '(?i)und|qu[ei]') then 'OTHER' end as case_category from conversations)
select conv_id, turn, case_category,
       case case_category when 'ACTION' then 'Doing' when 'PLACE' then 'Where' when 'OTHER' then 'Rest' end as case_title,
       case case_category when 'ACTION' then 'act,move' when 'PLACE' then 'here' when 'OTHER' then 'misc,else' end
         as principles
from c""".replace("\\\\", "\\"))
def classify_case(spark, sf):
    out = retrieval.classify_cases(table(spark, sf, "conversations"), "text", _TAXONOMY)
    return out.select("conv_id", "turn", "case_category", "case_title", F.array_join("principles", ",").alias(
        "principles"))


_MARKED = "concat(text, ' [Music] (noise)  end , so')"
_FILLER_SQL = r"(?i)(^|[\s।,?!])(uh|um|ah|of|de)($|[\s।,?!])"
_NO_BRACKETS = rf"regexp_replace(regexp_replace({_MARKED}, '\[.*?\]', ' ', 'g'), '\(.*?\)', ' ', 'g')"
_NO_FILLERS = (rf"regexp_replace(regexp_replace(regexp_replace({_NO_BRACKETS}, '{_FILLER_SQL}', '\1 \3', 'g'), "
               rf"'{_FILLER_SQL}', '\1 \3', 'g'), '{_FILLER_SQL}', '\1 \3', 'g')")


@R.add("normalize_text", rf"""
select doc_id, trim(regexp_replace(regexp_replace({_NO_FILLERS}, '\s+', ' ', 'g'), '\s*([।,?!])', '\1', 'g'))
       as clean_text
from documents""")
def normalize_text(spark, sf):
    d = documents(spark, sf).withColumn("text", F.concat("text", F.lit(" [Music] (noise)  end , so")))
    return d.select("doc_id", tx.normalize_transcript(
        F.col("text"), [*fixed.FILLERS, "of", "de"], stutters=False).alias("clean_text"))


@R.add("collapse_stutters")
def collapse_stutters(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", tx.normalize_transcript(F.col("text")).alias("clean_text"))


_LATIN = r"regexp_extract_all(lower(text), '[a-z]+')"
_LETTERS = r"regexp_replace(text, '[^\pL\pN_]|\p{Nd}', '', 'g')"


_SCRIPT = rf"""case
    when len(latin) > 0 and len(list_filter(latin, lambda w: list_contains({_list(fixed.ENGLISH_WORDS)}, w))) / len(latin)
         >= 0.35 then 'english'
    when length(letters) > 0 and length(regexp_replace(letters, '[^a-zA-Z]', '', 'g')) / length(letters) >= 0.4
         then 'romanised'
    else 'native' end"""


@R.add("detect_script", rf"""
with t as (select 'd' || doc_id as id, text from documents
           union all select 'c' || conv_id || '.' || turn, text from conversations),
m as (select id, {_LATIN} as latin, {_LETTERS} as letters from t)
select id, {_SCRIPT} as script
from m""")
def detect_script(spark, sf):
    d = documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    c = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.col("turn")).alias("id"), "text")
    return d.unionByName(c).select("id", tx.script_of(F.col("text")).alias("script"))


_LEX = {"the": "X1", "of the": "X2", "de": "X3", "en la": "X4"}
_PHR = [(r"\ban[d]?\b", "Y1"), (r"\bund\b", "Y2")]


def _lexicon_sql() -> str:
    sql = r"regexp_replace(lower(text), '^\s+|\s+$', '', 'g')"
    steps = [(t, _LEX[t]) for t in sorted(_LEX, key=len, reverse=True)] + [("an[d]?", "Y1"), ("und", "Y2")]
    for pattern, new in steps:
        for _ in range(2):
            sql = rf"regexp_replace({sql}, '(^|[^\pL\pN_])({pattern})($|[^\pL\pN_])', '\1 {new} \3', 'gi')"
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


@R.add("apply_lexicon", f"select conv_id, turn, {_lexicon_sql()} as normalized from conversations")
def apply_lexicon(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.replace_terms(F.col("text"), _LEX, _PHR).alias("normalized"))


_TABLE_SQL = r"""
with lex as (select distinct w as term, 'T' || length(w) as native
             from (select unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) as w from documents)
             where length(w) % 2 = 0),
t as (select conv_id, turn, regexp_extract_all(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'),
             '[\pL\pN_]+|[^\pL\pN_]+') as ps from conversations),
p as (select conv_id, turn, unnest(ps) as p, generate_subscripts(ps, 1) as i from t)
select conv_id, turn, trim(regexp_replace(string_agg(coalesce(' ' || native || ' ', p), '' order by i),
  '\s+', ' ', 'g')) as normalized
from p left join lex on p = term group by conv_id, turn"""


def _by_table(spark, sf, **how):
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"([{tx.WORD_CHAR}]+)"), F.lit(1)))
    lex = table(spark, sf, "documents").select(word.alias("term")).where(F.length("term") % 2 == 0).distinct().select(
        "term", F.concat(F.lit("T"), F.length("term")).alias("native"))
    return lexicon.replace_terms_by_table(table(spark, sf, "conversations"), lex, **how).select(
        "conv_id", "turn", "normalized")


@R.add("apply_lexicon_table", _TABLE_SQL)
def apply_lexicon_table(spark, sf):
    """Every word of even length of all documents is an entry."""
    return _by_table(spark, sf)


@R.add("apply_lexicon_joined", _TABLE_SQL)
def apply_lexicon_joined(spark, sf):
    """The same with the way for dictionaries that are too large to send."""
    return _by_table(spark, sf, send_bytes=0)


# every third turn gets accents as separate marks, which NFC joins to their letters
@R.add("normalize_query", rf"""
with t as (select conv_id, turn, case when turn % 3 = 0 then 'a' || chr(769) || 'é ' || text || ' cafe' || chr(769)
             when turn % 3 = 1 then 'мост ' || text || ' и' || chr(774) else text end as text from conversations),
m as (select *, {_LATIN} as latin, {_LETTERS} as letters from t)
select conv_id, turn, case {_SCRIPT} when 'english' then trim(text) when 'romanised' then {_lexicon_sql()}
  else trim(nfc_normalize(text)) end as normalized
from m""")
def normalize_query(spark, sf):
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a\u0301é "), "text", F.lit(" cafe\u0301"))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("мост "), "text", F.lit(" и\u0306"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.normalize_query(marked, _LEX, _PHR).alias("normalized"))


@R.add("keyword_search", """
select p_partkey, p_name from part where p_type = 'ECONOMY'
  and (contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring'))
union all
select p_partkey, p_name from part where contains(lower(p_brand), '#2') and p_type <> 'ECONOMY'""")
def keyword_search(spark, sf):
    p = table(spark, sf, "part")
    cols = [F.col("p_name"), F.col("p_brand"), F.col("p_type")]
    tags = F.split("p_name", " ")
    one = p.where((F.col("p_type") == "ECONOMY") & tx.contains_any(cols, F.lit(" RING "), tags))
    two = p.where((F.col("p_type") != "ECONOMY") & tx.contains_any([F.col("p_brand")], F.lit("#2")))
    return one.unionByName(two).select("p_partkey", "p_name")


@R.add("highlight", r"""
select p_partkey, regexp_replace(p_name, '(?i)(RE)', '<mark>\1</mark>', 'g') as marked,
       replace(p_brand, '#1', '<mark>#1</mark>') as brand from part""")
def highlight(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", tx.highlight(F.col("p_name"), "RE").alias("marked"),
        tx.highlight(F.col("p_brand"), "#1").alias("brand"))


_SECS = "cast(floor(value * 100) as bigint)"


@R.add("format_timestamp", f"select event_id, {clock_sql(_SECS)} as label, {_SECS} as seconds from events")
def format_timestamp(spark, sf):
    label = tx.format_timestamp(F.col("value") * 100)
    return table(spark, sf, "events").select("event_id", label.alias("label"), tx.parse_timestamp(label).alias(
        "seconds"))


@R.add("parse_timestamp", """
select event_id, event_id // 60 || ':' || event_id % 60 as label, event_id as seconds from events
union all select -event_id, event_type || ':' || event_id, null from events""")
def parse_timestamp(spark, sf):
    e = table(spark, sf, "events")
    good = e.select("event_id", F.concat_ws(":", F.floor(F.col("event_id") / 60), F.col("event_id") % 60).alias("label"))
    bad = e.select((-F.col("event_id")).alias("event_id"), F.concat_ws(":", "event_type", "event_id").alias("label"))
    return good.unionByName(bad).withColumn("seconds", tx.parse_timestamp(F.col("label")))


@R.add("estimate_tokens", f"select doc_id, len({WORDS_SQL}) + length(text) // 8 as tokens from documents")
def estimate_tokens(spark, sf):
    return documents(spark, sf).select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@R.add("make_citations", f"""
with s as (select *, doc_id * 37 % 9000 as a, doc_id * 37 % 9000 + 50 as b from documents)
select doc_id, case when doc_id % 3 = 0 then 'Recording (' || doc_id || ')' else 'Doc ' || doc_id end as title,
       'https://youtu.be/' || doc_id || '?t=' || a as url,
       '[' || source || ' • ' || {clock_sql('a')} || ']' as label, {clock_sql('b')} as timestamp_end,
       round(n_chars / 40000.0, 3) as relevance_score,
       substr(text, 1, 280) || case when length(text) > 280 then '...' else '' end as excerpt
from s""")
def make_citations(spark, sf):
    d = documents(spark, sf)
    start = F.col("doc_id") * 37 % 9000
    hits = d.select(
        "doc_id", F.col("doc_id").alias("video_id"), F.col("source").alias("channel_title"), start.alias("start_sec"),
        (start + 50).alias("end_sec"), F.col("text").alias("clean_text"), (F.col("n_chars") / 40000.0).alias(
            "similarity"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Doc "), F.col("doc_id"))).alias("title"))
    return retrieval.make_citations(hits).select(
        "doc_id", "title", "url", "label", "timestamp_end", "relevance_score", "excerpt")


_ECHO_SQL = r"""case turn % 3 when 0 then '**Question:** ' || text || E'\n\n---\n\n' || text
  when 1 then 'question: "' || replace(text, E'\n', ' ') || E'"\n' || text else E'---\n\n' || text end"""
_LABEL = r"^\s*\*{0,2}(?:प्रश्न|Question|साधक का प्रश्न)\s*[:：]\*{0,2}"


@R.add("sanitize_answer", rf"""
with e as (select conv_id, turn, trim({_ECHO_SQL}) as a from conversations),
b as (select conv_id, turn, regexp_replace(a, '(?i){_LABEL}[\s\S]*?(?:-{{3,}}\s*|\n{{2,}})(\S)', '\1') as a from e),
c as (select conv_id, turn, regexp_replace(trim(a), '(?i){_LABEL}\s*["“''‘][^"”''’\n]+["”''’]\s*(?:-{{3,}}\s*|\n+)', '') as a
      from b)
select conv_id, turn, trim(regexp_replace(trim(a), '^\s*-{{3,}}\s*\n+', '')) as answer from c""")
def sanitize_answer(spark, sf):
    c = table(spark, sf, "conversations")
    text, kind = F.col("text"), F.col("turn") % 3
    echoed = (
        F.when(kind == 0, F.concat(F.lit("**Question:** "), text, F.lit("\n\n---\n\n"), text))
        .when(kind == 1, F.concat(F.lit('question: "'), F.replace(text, F.lit("\n"), F.lit(" ")), F.lit('"\n'), text))
        .otherwise(F.concat(F.lit("---\n\n"), text)))
    return c.select("conv_id", "turn", tx.strip_echoed_question(echoed).alias("answer"))


@R.add("flag_refusal", """
with a as (select conv_id, turn, case when turn % 4 = 1 then '### ' || text else text end as answer from conversations)
select conv_id, turn, not contains(answer, '###') and (contains(answer, 'ing the') or contains(answer, ' que ')
       or contains(answer, 'और नहीं')) as is_refusal from a""")
def flag_refusal(spark, sf):
    answer = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("### "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.is_refusal(answer, ["ing the", " que ", "और नहीं"]).alias("is_refusal"))


@R.add("extract_video_id", r"""
select page_id, case when regexp_matches(url, '(v=|/|youtu\.be/)[0-9A-Za-z_-]{11}')
       then regexp_extract(url, '(?:v=|/|youtu\.be/)([0-9A-Za-z_-]{11})', 1) else url end as video_id from pages
union all select -1 - page_id, lpad(cast(page_id as varchar), 11, 'x') from pages""")
def extract_video_id(spark, sf):
    p = table(spark, sf, "pages")
    short = p.select((-1 - F.col("page_id")).alias("page_id"), F.concat(
        F.lit("https://youtu.be/"), F.lpad(F.col("page_id").cast("string"), 11, "x"), F.lit("?t=5")).alias("url"))
    return p.select("page_id", "url").unionByName(short).select("page_id", tx.video_id_of(F.col("url")).alias("video_id"))


@R.add("assign_channel", """
select doc_id, case when contains(lower(source), 'src1') then 'one' when contains(lower(source), '5') then 'five'
       when contains(lower(source), 'src2') then 'two' else 'rest' end as channel
from documents""")
def assign_channel(spark, sf):
    return documents(spark, sf).select("doc_id", tx.channel_by_rules(
        F.col("source"), [("src1", "one"), ("5", "five"), ("src2", "two")], "rest").alias("channel"))


@R.add("normalize_punct", """
select doc_id, replace(replace(text, ',', '-'), chr(10), ' ') as clean from documents""")
def normalize_punct(spark, sf):
    # em dash for comma, no-break space for newline
    odd = F.replace(F.replace(F.col("text"), F.lit(","), F.lit("\u2014")), F.lit("\n"), F.lit("\u00a0"))
    return documents(spark, sf).select("doc_id", tx.normalize_punct(odd).alias("clean"))
