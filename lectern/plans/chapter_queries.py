"""Chapters, sentences, chunks, segments and the lengths of audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.patterns import ABBREVIATIONS, CHAPTER_WORDS, FRONT_MATTER, HEADING_PAUSE, QUOTE_PAUSE, WS
from lectern.operators import audio as A
from lectern.operators import chapters as C
from lectern.operators import chunking as K
from lectern.plans.inputs import DOCS, docs, sql_clean, sql_replace, sql_strip, sql_words
from lectern.plans.ordinal_sql import sql_ordinal
from lectern.plans.registry import query
from lectern.plans.text_queries import sql_digits, sql_quotes
from lectern.session import table

_listed = lambda words: "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"

KEYWORD = f"(len(list_filter({_listed(FRONT_MATTER)}, lambda k: contains(lower(title), k) OR contains(lower(filename), k))) > 0)"
SKIP = f"({KEYWORD} OR length(content) < 400 OR ({sql_digits('content')}) > 0.3)"
LIKELY = f"(len(list_filter({_listed(CHAPTER_WORDS)}, lambda k: contains(lower(title), k))) > 0 OR regexp_matches(lower(title), '^(?:rozdział|chapter|część|czesc|part)?{WS}*[0-9ivx]+') OR length(content) > 1000)"
ROUTED = (
    f"flagged AS (SELECT *, {SKIP} AS skip, NOT {SKIP} AND {LIKELY} AS likely FROM docs), "
    "routed AS (SELECT *, max(likely) OVER (PARTITION BY book_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS begun FROM flagged)"
)
CHAPTERS = f"chapters AS (SELECT book_id, pos, row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1 AS chapter_idx, {sql_replace(sql_replace('title', '[<>:\"/\\\\|?*]', ''), f'{WS}+', '_')}[:50] AS title, content FROM routed WHERE NOT skip AND begun)"
BASE = f"WITH {DOCS}, {ROUTED}, {CHAPTERS}"


@query(f"WITH {DOCS} SELECT doc_id, {SKIP} AS skip FROM docs")
def skip_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.should_skip(F.col("title"), F.col("content"), F.col("filename")).alias("skip"))


@query(f"WITH {DOCS} SELECT doc_id, {LIKELY} AS likely FROM docs")
def likely_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.likely_chapter(F.col("title"), F.col("content")).alias("likely"))


@query(f"{BASE} SELECT book_id, pos FROM routed WHERE NOT skip AND begun")
def after_first_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are kept: not skipped, and from their book's first chapter on."""
    return C.routed(docs(spark, sf_dir)).where("reason IS NULL").select("book_id", "pos")


@query(f"{BASE} SELECT book_id, pos, title, CASE WHEN skip THEN '{C.SKIPPED}' ELSE '{C.BEFORE}' END AS reason FROM routed WHERE skip OR NOT begun")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.routed(docs(spark, sf_dir)).where("reason IS NOT NULL").select("book_id", "pos", "title", "reason")


@query(f"{BASE} SELECT book_id, count(*) AS found, sum((skip OR NOT begun)::INT)::BIGINT AS skipped FROM routed GROUP BY book_id")
def skip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.routed(docs(spark, sf_dir)).groupBy("book_id").agg(F.count("*").alias("found"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))


@query(f"{BASE} SELECT book_id, count(*) AS chapters, sum(length(content))::BIGINT AS chars, sum(CASE WHEN chapter_idx = 0 THEN length(content) END)::BIGINT AS first_chars FROM chapters GROUP BY book_id")
def chapter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.chapters(docs(spark, sf_dir))
    first = F.sum(F.when(F.col("chapter_idx") == 0, F.length("content")))
    return kept.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum(F.length("content")).alias("chars"), first.alias("first_chars"))


@query(f"{BASE} SELECT round(sum(length(content)) / 300 * 5 / 60, 6) AS minutes FROM chapters")
def eta_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chapters(docs(spark, sf_dir)).agg(F.round(F.sum(F.length("content")) / 300 * 5 / 60, 6).alias("minutes"))


@query(f"{BASE} SELECT book_id, 0 AS chapter_idx, 'Intro' AS title, book_id || '. Nieznany autor.' AS content FROM (SELECT DISTINCT book_id FROM chapters) UNION ALL SELECT book_id, chapter_idx + 1, title, content FROM chapters")
def intro_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoken introduction before each book's chapters."""
    kept = C.chapters(docs(spark, sf_dir)).withColumn("chapter_idx", F.col("chapter_idx") + 1)
    intro = kept.select("book_id").distinct().select("book_id", F.lit(0).alias("chapter_idx"), F.lit("Intro").alias("title"), F.concat("book_id", F.lit(". Nieznany autor.")).alias("content"))
    return intro.unionByName(kept)


SPINE = (
    "items AS (SELECT o_custkey % 50 AS book_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS pos FROM orders), "
    "spine AS (SELECT book_id, item_id, row_number() OVER (PARTITION BY book_id ORDER BY item_id % 97, item_id) - 1 AS spine_pos FROM items WHERE item_id % 10 <> 3)"
)


def spine_and_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("book_id"), F.col("o_orderkey").alias("item_id"))
    items = orders.withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("item_id")) - 1)
    listed = orders.where("item_id % 10 <> 3")
    spine = listed.withColumn("spine_pos", F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("item_id") % 97, "item_id")) - 1)
    return spine, items


@query(f"WITH {SPINE} SELECT book_id, item_id, row_number() OVER (PARTITION BY book_id ORDER BY p, place) - 1 AS reading_pos FROM (SELECT s.book_id, s.item_id, 0 AS p, spine_pos AS place FROM spine s JOIN items USING (book_id, item_id) UNION ALL SELECT book_id, item_id, 1, pos FROM items i WHERE NOT EXISTS (SELECT 1 FROM spine s WHERE s.book_id = i.book_id AND s.item_id = i.item_id))")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reading_order(*spine_and_items(spark, sf_dir))


@query(f"WITH {SPINE} SELECT book_id, count(*) AS shared, count(*) > 0 AS overlaps FROM (SELECT book_id, item_id FROM spine INTERSECT SELECT book_id, item_id FROM items) GROUP BY book_id")
def spine_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine, items = spine_and_items(spark, sf_dir)
    shared = spine.select("book_id", "item_id").intersect(items.select("book_id", "item_id"))
    return shared.groupBy("book_id").agg(F.count("*").alias("shared"), (F.count("*") > 0).alias("overlaps"))


def sql_sentences(x: str) -> str:
    marked = sql_replace(x, '([„"][^"]*")', "\x02\\1\x02")
    cut = sql_replace("p", f"([.!?…]){WS}+([{K.OPENS}])", "\\1\x01\\2")
    joined = f"array_to_string(list_transform(string_split({marked}, chr(2)), lambda p, i: CASE WHEN i % 2 = 1 THEN {cut} ELSE p END), '')"
    return f"list_filter(list_transform(string_split({joined}, chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_abbrev(x: str) -> str:
    bare = sql_replace(x, f"{WS}+$", "")
    word = f"regexp_extract({bare}, '([\\p{{L}}\\p{{N}}_]+)\\.$', 1)"
    return f"(regexp_matches({bare}, '^[0-9]+\\.$') OR list_contains({_listed(ABBREVIATIONS)}, lower({word})) OR (length({word}) = 1 AND upper({word}) = {word}))"


CUT = f"cut AS (SELECT book_id, pos, chapter_idx, {sql_sentences('content')} AS s FROM (SELECT book_id, pos, chapter_idx, {sql_quotes(sql_clean('content'))} AS content FROM chapters))"
MERGED = (
    "merged AS (SELECT book_id, pos, chapter_idx, list_append(r.out, r.cur) AS s FROM (SELECT book_id, pos, chapter_idx, list_reduce(list_transform(s, lambda x: {'out': []::VARCHAR[], 'cur': x}), "
    f"lambda a, e: CASE WHEN {sql_abbrev('a.cur')} THEN {{'out': a.out, 'cur': a.cur || ' ' || e.cur}} ELSE {{'out': list_append(a.out, a.cur), 'cur': e.cur}} END) AS r FROM cut WHERE len(s) > 0))"
)
_mark = f"(contains(e.cur, '{HEADING_PAUSE}') OR contains(e.cur, '{QUOTE_PAUSE}'))"
_flushed = "(CASE WHEN a.cur = '' THEN a.out ELSE list_append(a.out, a.cur) END)"
_full = "(length(a.cur) + length(e.cur) + 1 > 300 OR a.n + e.n > 150)"
PACKED = (
    f"packed AS (SELECT book_id, pos, chapter_idx, list_filter(CASE WHEN r.cur = '' THEN r.out ELSE list_append(r.out, r.cur) END, lambda c: length(c) >= 10) AS s FROM (SELECT book_id, pos, chapter_idx, list_reduce(list_prepend({{'out': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}}, list_transform(s, lambda x: {{'out': []::VARCHAR[], 'cur': x, 'n': {sql_words('x')}::BIGINT}})), "
    f"lambda a, e: CASE WHEN {_mark} THEN {{'out': list_append({_flushed}, e.cur), 'cur': '', 'n': 0::BIGINT}} WHEN a.cur = '' THEN {{'out': a.out, 'cur': e.cur, 'n': e.n}} "
    f"WHEN {_full} THEN {{'out': {_flushed}, 'cur': e.cur, 'n': e.n}} ELSE {{'out': a.out, 'cur': a.cur || ' ' || e.cur, 'n': a.n + e.n}} END) AS r FROM merged))"
)
CHUNKS = "chunks AS (SELECT book_id, pos, chapter_idx, unnest(s) AS chunk, generate_subscripts(s, 1) - 1 AS chunk_idx FROM packed)"


def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chapters(docs(spark, sf_dir)).select("book_id", "chapter_idx", "content")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_texts(spark, sf_dir).withColumn("content", T.annotate_quotes(T.clean_text(F.col("content"))))


@query(f"{BASE}, {CUT} SELECT book_id, chapter_idx, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS idx FROM cut")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("book_id", "chapter_idx", F.posexplode(K.sentences(F.col("content"))).alias("idx", "sentence"))


@query(f"{BASE}, {CUT}, {MERGED} SELECT book_id, chapter_idx, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS idx FROM merged")
def merge_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("book_id", "chapter_idx", F.posexplode(K.merge_abbrev(K.sentences(F.col("content")))).alias("idx", "sentence"))


@query(f"{BASE}, {CUT} SELECT book_id, chapter_idx, idx, {sql_abbrev('x')} AS ends FROM (SELECT book_id, chapter_idx, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS idx FROM cut)")
def abbrev_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("book_id", "chapter_idx", F.posexplode(K.sentences(F.col("content"))).alias("idx", "x")).select("book_id", "chapter_idx", "idx", K.abbrev_ending(F.col("x")).alias("ends"))


@query(f"{BASE}, {CUT}, {MERGED}, {PACKED}, {CHUNKS} SELECT book_id, chapter_idx, chunk_idx, chunk FROM chunks")
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(kept_texts(spark, sf_dir), raw=True)


@query(f"{BASE}, {CUT} SELECT book_id, chapter_idx, len(list_filter(s, lambda c: length(c) >= 10))::INT AS kept, len(s)::INT AS found FROM cut")
def min_chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = prepared(spark, sf_dir).select("book_id", "chapter_idx", F.inline(F.array(F.struct(K.sentences(F.col("content")).alias("parts")))))
    parts = F.col("parts")
    return cut.select("book_id", "chapter_idx", F.size(F.filter(parts, lambda c: F.length(c) >= K.LEAST)).alias("kept"), F.size(parts).alias("found"))


_own = f"CASE WHEN contains(chunk, '{HEADING_PAUSE}') THEN 2000 WHEN contains(chunk, '{QUOTE_PAUSE}') THEN 1000 ELSE 0 END"
PAUSED = (
    f"paused AS (SELECT book_id, chapter_idx, chunk_idx, CASE WHEN coalesce(contains(lead(chunk) OVER (PARTITION BY book_id, chapter_idx ORDER BY chunk_idx), 'Koniec cytatu'), false) THEN greatest({_own}, 1500) ELSE {_own} END AS pause_ms, "
    + sql_strip(f"replace(replace(chunk, '{HEADING_PAUSE}', ''), '{QUOTE_PAUSE}', '')")
    + " AS spoken FROM chunks)"
)


@query(f"{BASE}, {CUT}, {MERGED}, {PACKED}, {CHUNKS}, {PAUSED} SELECT book_id, chapter_idx, chunk_idx, pause_ms, spoken FROM paused WHERE length(spoken) >= 10")
def chunk_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pauses(kept_texts(spark, sf_dir), raw=True).drop("chunk")


def sql_params(x: str) -> str:
    commas = f"(length({x}) - length(replace({x}, ',', '')) > 5 OR length({x}) - length(replace({x}, chr(10), '')) > 2)"
    talk = f"regexp_matches({x}, '[\"„“]')"
    return f"CASE WHEN {talk} OR {commas} THEN 0.6::DOUBLE ELSE 0.55::DOUBLE END AS temperature, CASE WHEN {talk} THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS top_p, 1.5::DOUBLE AS repetition_penalty, CASE WHEN {commas} THEN 1.0::DOUBLE * 0.9::DOUBLE WHEN contains({x}, '?') THEN 1.0::DOUBLE * 0.95::DOUBLE ELSE 1.0::DOUBLE END AS speed"


@query(f"{BASE}, {CUT}, {MERGED}, {PACKED}, {CHUNKS} SELECT book_id, chapter_idx, chunk_idx, {sql_params('chunk')} FROM chunks")
def synth_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(kept_texts(spark, sf_dir), raw=True).select("book_id", "chapter_idx", "chunk_idx", F.inline(F.array(K.synth_params(F.col("chunk"), F.lit(1.0)))))


# The heading in SQL: the title's words are those before the first that ends it.
_prefix = f"regexp_extract(t, '^((?i:rozdział|rozdzial|chapter|część|czesc|part){WS}*[0-9]+)', 1)"
_clean = "regexp_replace(w[i], '[,.\"()\\-]', '', 'g')"
_after = "regexp_replace(coalesce(w[i + 1], ''), '[,.\"]', '', 'g')"
_ends = f"({_clean} <> '' AND ((length({_clean}) = 1 AND regexp_matches({_clean}, '^\\p{{Lu}}') AND regexp_matches({_after}, '^\\p{{Ll}}')) OR NOT (regexp_matches({_clean}, '^\\p{{Lu}}') AND NOT regexp_matches({_clean}, '\\p{{Ll}}'))))"
_number = "regexp_extract(p, '([0-9]+)$', 1)"
HEADED = (
    f"h0 AS (SELECT book_id, pos, chapter_idx, {sql_clean('content')} AS t FROM chapters), "
    f"h1 AS (SELECT *, {_prefix} AS p, list_filter(string_split_regex(regexp_replace(t, '^(?i:rozdział|rozdzial|chapter|część|czesc|part){WS}*[0-9]+{WS}*', ''), '{WS}+'), lambda x: x <> '') AS w FROM h0), "
    f"h2 AS (SELECT *, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: {_ends})) - 1, len(w)) AS n FROM h1), "
    "h3 AS (SELECT *, array_to_string(w[:n], ' ') AS head, array_to_string(w[n + 1:], ' ') AS rest FROM h2), "
    f"headed AS (SELECT book_id, pos, chapter_idx, CASE WHEN p <> '' AND rest <> '' THEN trim(coalesce(regexp_replace(p, '[0-9]+$', '') || {sql_ordinal('try_cast(' + _number + ' AS INTEGER)', 'm')}, p) || CASE WHEN n > 0 THEN ' ' || head ELSE '' END) END AS heading, CASE WHEN p <> '' AND rest <> '' THEN rest ELSE t END AS body FROM h3)"
)


@query(f"{BASE}, {HEADED} SELECT book_id, chapter_idx, heading, body FROM headed")
def separate_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.chapters(docs(spark, sf_dir)).select("book_id", "chapter_idx", T.clean_text(F.col("content")).alias("content"))
    return kept.select("book_id", "chapter_idx", F.inline(F.array(C.separate_heading(F.col("content")))))


PLAN_CUT = f"cut AS (SELECT book_id, pos, chapter_idx, {sql_sentences('body')} AS s FROM headed)"
_spoken = "CASE WHEN regexp_matches(v, '[.!?…]$') THEN v ELSE v || '.' END"
PLAN = (
    "plan AS (SELECT book_id, chapter_idx, -1 AS seq, heading AS v, 2500 AS pause_before_ms, 2500 AS pause_after_ms FROM headed WHERE heading IS NOT NULL "
    "UNION ALL SELECT book_id, chapter_idx, chunk_idx, spoken, 0, pause_ms FROM paused WHERE length(spoken) >= 10)"
)


@query(f"{BASE}, {HEADED}, {PLAN_CUT}, {MERGED}, {PACKED}, {CHUNKS}, {PAUSED}, {PLAN} SELECT book_id, chapter_idx, seq, spoken, pause_before_ms, pause_after_ms, {sql_params('spoken')} FROM (SELECT *, {_spoken} AS spoken FROM plan)")
def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to the plan of all segments: filter, heading, sentences, chunks, pauses, parameters."""
    kept = C.chapters(docs(spark, sf_dir)).select("book_id", "chapter_idx", T.clean_text(F.col("content")).alias("content"))
    return K.segment_plan(kept)


@query(f"{BASE}, {CUT}, {MERGED}, {PACKED}, {CHUNKS} SELECT book_id, chapter_idx, chunk_idx FROM chunks WHERE chapter_idx > 3 OR (chapter_idx = 3 AND chunk_idx >= 2)")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a checkpoint at chapter 3, chunk 2."""
    at = spark.createDataFrame([(3, 2)], "current_chapter int, current_chunk int")
    # Chapters before it are done, so they aren't cut.
    left = kept_texts(spark, sf_dir).join(F.broadcast(at), F.col("chapter_idx") >= F.col("current_chapter"))
    rows = K.chunks(left, raw=True).where((F.col("chapter_idx") > F.col("current_chapter")) | (F.col("chunk_idx") >= F.col("current_chunk")))
    return rows.select("book_id", "chapter_idx", "chunk_idx")


@query(f"{BASE}, {CUT}, {MERGED}, {PACKED}, {CHUNKS} SELECT book_id, chapter_idx, chunk_idx // 50 AS batch, count(*) AS segments, sum(length(chunk))::BIGINT AS chars FROM chunks GROUP BY ALL")
def segment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments combined fifty at a time."""
    batch = F.floor(F.col("chunk_idx") / 50)
    return K.chunks(kept_texts(spark, sf_dir), raw=True).groupBy("book_id", "chapter_idx", batch.alias("batch")).agg(F.count("*").alias("segments"), F.sum(F.length("chunk")).alias("chars"))


@query(f"{BASE}, {CUT}, {MERGED}, {PACKED}, {CHUNKS} SELECT book_id, chapter_idx, chunk_idx, md5(c) AS audio_key, length(c) * 60 AS duration_ms FROM (SELECT *, CASE WHEN v = '' OR regexp_matches(v, '[.!?…]$') THEN v ELSE v || '.' END AS c FROM (SELECT *, " + sql_replace("chunk", f"{WS}+$", "") + " AS v FROM chunks))")
def synthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through the stand-in synthesiser, which says how long its audio would be."""
    from lectern.operators.synthesis import StubSynthesizer, synthesize

    return synthesize(K.chunks(kept_texts(spark, sf_dir), raw=True), StubSynthesizer()).select("book_id", "chapter_idx", "chunk_idx", "audio_key", "duration_ms")


FRAMES = "frames AS (SELECT user_id AS seg_id, floor(epoch_ms(ts) / 3600000)::BIGINT AS ms, max(-20.0 - value) AS dbfs FROM events GROUP BY ALL)"
RANGES = (
    "f AS (SELECT seg_id, ms, dbfs > -65.0 AS loud, lag(dbfs > -65.0, 1, false) OVER w AS was FROM frames WINDOW w AS (PARTITION BY seg_id ORDER BY ms)), "
    "g AS (SELECT *, sum((loud <> was)::INT) OVER (PARTITION BY seg_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS island FROM f), "
    "ranges AS (SELECT seg_id, min(ms) AS start_ms, max(ms) + 1 AS end_ms FROM g WHERE loud GROUP BY seg_id, island)"
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness by frame: for each user and hour the quietest value, as if in milliseconds."""
    hour = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seg_id"), hour.alias("ms")).agg(F.max(-20.0 - F.col("value")).alias("dbfs"))


@query(f"WITH {FRAMES}, {RANGES} SELECT * FROM ranges")
def nonsilent_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of frames that are louder than the threshold."""
    return A.nonsilent_ranges(frames(spark, sf_dir), -65.0)


ORIGIN = "474816"  # hours from the epoch to 2024-03-02


@query(
    f"WITH {FRAMES}, {RANGES}, t AS (SELECT seg_id, {ORIGIN} AS total FROM ranges GROUP BY seg_id), "
    "p AS (SELECT seg_id, start_ms, end_ms, lag(end_ms, 1, 0) OVER (PARTITION BY seg_id ORDER BY start_ms) AS prev_end, row_number() OVER (PARTITION BY seg_id ORDER BY start_ms DESC) = 1 AS is_last, total FROM ranges JOIN t USING (seg_id)) "
    "SELECT seg_id, start_ms, floor((start_ms - prev_end) * 1.5)::BIGINT AS gap_ms, end_ms - start_ms AS speech_ms, CASE WHEN is_last THEN floor(greatest(total - end_ms, 0) * 1.5)::BIGINT ELSE 0 END AS trailing_ms FROM p"
)
def stretch_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences between ranges, before the first and after the last, longer by half."""
    return A.stretched(A.nonsilent_ranges(frames(spark, sf_dir), -65.0), F.lit(int(ORIGIN)), 1.5)


@query(f"WITH {FRAMES}, {RANGES} SELECT seg_id, CASE WHEN least(max(end_ms) + 400, {ORIGIN} + 2000) < {ORIGIN} + 2000 - 500 THEN least(max(end_ms) + 400, {ORIGIN} + 2000) ELSE {ORIGIN} + 2000 END AS kept_ms FROM ranges GROUP BY seg_id")
def trim_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each segment is left when a long silence at its end is cut."""
    return A.trimmed(A.nonsilent_ranges(frames(spark, sf_dir), -65.0), F.lit(int(ORIGIN) + 2000))


@query("SELECT vec_id, len(embedding) + 300 AS padded_ms FROM embeddings")
def pad_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", A.padded(F.size("embedding").cast("bigint"), 150).alias("padded_ms"))
