"""Generated books: outlines, prompts, checks, titles, settings, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import generation as R
from lectern.plans.inputs import sql_words
from lectern.plans.registry import query
from lectern.session import table

OUTLINE = "concat('## Rozdział 1: A', chr(10), substr(text, 1, 40), chr(10), '## Rozdział 12: B', chr(10), 'dwanaście', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('## Rozdział 2: C', chr(10), 'dwa ', doc_id, chr(10), '### x', chr(10)) ELSE '' END)"
SPARK_OUTLINE = OUTLINE.replace("chr(10)", "char(10)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(nullif(regexp_extract(b, 'Liczba rozdziałów:\\s*([0-9]+)', 1), '')::INT, 5) ELSE len(regexp_extract_all(o, '(?m)^## '))::INT END AS n FROM (SELECT doc_id, {OUTLINE} AS o, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE concat('Liczba rozdziałów: ', doc_id % 40) END AS b FROM documents)"
)
def outline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).selectExpr("doc_id", f"CASE WHEN doc_id % 3 > 0 THEN {SPARK_OUTLINE} END AS o", "CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE concat('Liczba rozdziałów: ', doc_id % 40) END AS b")
    return df.select("doc_id", R.chapter_count(F.col("o"), F.col("b")).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('dwa ', doc_id, chr(10), '### x', chr(10)) ELSE '' END AS section FROM documents")
def outline_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of chapter 2, not of 12."""
    return documents(spark, sf_dir).select("doc_id", R.outline_section(F.expr(SPARK_OUTLINE), F.lit(2)).alias("section"))


@query(
    "SELECT conv_id, turn, 'Zasady' || s || text || CASE WHEN role = 'user' THEN s || 'Styl' ELSE '' END || s || 'Napisz rozdział ' || turn || ' z 9.' || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Wskazówki:' || chr(10) || 'w' || turn ELSE '' END || "
    "coalesce(s || 'Streszczenie:' || chr(10) || nullif(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '') AS prompt FROM (SELECT *, chr(10) || chr(10) || '---' || chr(10) || chr(10) AS s FROM conversations)"
)
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's prompt with the text of the turn before as its summary."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    style, outline = F.when(F.col("role") == "user", F.lit("Styl")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("w"), F.col("turn").cast("string")))
    before = F.lag("text").over(order)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.prompt(F.lit("Zasady"), F.col("text"), style, F.col("turn"), F.lit(9), outline, before).alias("prompt"))


QA = "concat(CASE WHEN doc_id % 4 > 0 THEN '# T' ELSE 'T' END, chr(10), text, CASE doc_id % 7 WHEN 0 THEN ' todo ' WHEN 1 THEN '[...]' ELSE '' END)"


@query(f"SELECT doc_id, length(t) = 0 AS is_empty, NOT regexp_matches(t, '(?m)^# ') AS no_heading, {sql_words('t')} < 500 AS too_short, regexp_matches(t, '(?i)(TODO|insert here|\\[\\.\\.\\.\\]|\\[wstaw\\])') AS placeholder FROM (SELECT doc_id, {QA} AS t FROM documents)")
def chapter_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.expr(QA.replace("chr(10)", "char(10)")).alias("t")).select("doc_id", F.inline(F.array(R.quality_checks(F.col("t")))))


@query("SELECT doc_id, contains(upper(concat(text, CASE WHEN doc_id % 3 = 0 THEN ' Verdict: fail.' ELSE '' END)), 'FAIL') AS failed FROM documents")
def review_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" Verdict: fail.")).otherwise(F.lit("")))
    return documents(spark, sf_dir).select("doc_id", R.failed_review(text).alias("failed"))


BOOK = "concat(CASE WHEN p_size % 3 > 0 THEN concat(p_brand, CASE WHEN p_size % 2 = 0 THEN ' — ' ELSE ' - ' END) ELSE '' END, CASE p_size % 4 WHEN 0 THEN 'Tom IV' WHEN 1 THEN concat('tom ', p_size) WHEN 2 THEN 'Tom XII' ELSE 'Opowieść' END, CASE WHEN p_size % 5 > 0 THEN concat(': ', p_name) ELSE '' END)"
_roman = "CASE r " + " ".join(f"WHEN '{r}' THEN '{n}'" for n, r in enumerate("I II III IV V VI VII VIII IX X".split(), 1)) + " ELSE r END"


@query(
    f"SELECT p_partkey, try_cast({_roman} AS INT) AS tom, nullif(trim(regexp_extract(t, '^(.*)\\s*[—–-]\\s*[Tt]om', 1)), '') AS series, coalesce(nullif(regexp_extract(t, '.*[Tt]om\\s*[IVXLC0-9]*:\\s*(.*)', 1), ''), t) AS subtitle FROM (SELECT p_partkey, t, regexp_extract(t, '.*[Tt]om\\s*([IVXLC]*[0-9]*)', 1) AS r FROM (SELECT p_partkey, {BOOK} AS t FROM part))"
)
def title_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{BOOK} AS t").select("p_partkey", F.inline(F.array(R.title_parts(F.col("t")))))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'afftdn=nf=-25:tn=1' END, 'highpass=f=40,lowpass=f=15000', CASE WHEN o_orderkey % 3 = 0 THEN 'adeclick=threshold=0.05:window=55:overlap=75,acompressor=threshold=-20dB:ratio=4:attack=5:release=50' END, CASE WHEN o_orderkey % 5 = 0 THEN 'loudnorm=I=-16:TP=-1.5:LRA=11' END) AS filters FROM orders")
def ffmpeg_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda n: F.col("o_orderkey") % n == 0
    return table(spark, sf_dir, "orders").select("o_orderkey", R.filter_chain(flag(2), flag(3), flag(5)).alias("filters"))


@query(
    "SELECT p_partkey, profile, CASE WHEN asked_size = 300 THEN CASE profile WHEN 'speed' THEN 400 WHEN 'quality' THEN 200 ELSE 300 END ELSE asked_size END AS chunk_size FROM (SELECT p_partkey, asked_size, CASE WHEN named = 'speed' AND NOT gpu THEN 'balanced' ELSE named END AS profile FROM (SELECT *, "
    "CASE WHEN asked IS NULL OR asked = 'off' THEN 'off' WHEN asked = 'auto' THEN CASE WHEN gpu THEN CASE WHEN gb >= 8 THEN 'speed' ELSE 'balanced' END WHEN cores >= 8 AND ram >= 16 THEN 'balanced' ELSE 'quality' END ELSE asked END AS named FROM "
    "(SELECT p_partkey, ['auto', 'speed', 'quality', 'balanced', 'off', NULL][1 + p_partkey % 6] AS asked, p_size % 2 = 0 AS gpu, p_size % 16 AS gb, p_size % 12 AS cores, p_size AS ram, CASE WHEN p_partkey % 4 = 0 THEN 250 ELSE 300 END AS asked_size FROM part)))"
)
def optimize_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ["auto", "speed", "quality", "balanced", "off", None])), (F.col("p_partkey") % 6 + 1).cast("int"))
    size = F.col("p_size")
    df = table(spark, sf_dir, "part").select("p_partkey", R.profile(asked, size % 2 == 0, size % 16, size % 12, size).alias("profile"))
    return df.select("p_partkey", "profile", R.chunk_size(F.col("profile"), F.when(F.col("p_partkey") % 4 == 0, 250).otherwise(300)).alias("chunk_size"))


@query("SELECT p_partkey, n = 1 AND speed BETWEEN 0.5 AND 2.0 AND regexp_matches(slug, '^[a-z0-9_-]+$') AND coalesce(regexp_matches(tom, '^[0-9]+$'), true) AS valid FROM (SELECT p_partkey, p_size % 3 AS n, p_size / 20.0 AS speed, CASE WHEN p_partkey % 5 = 0 THEN 'Zły slug' ELSE concat('b-', p_partkey) END AS slug, CASE p_partkey % 3 WHEN 0 THEN 'V' WHEN 1 THEN '5' END AS tom FROM part)")
def validate_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 3 AS n", "p_size / 20.0D AS speed", "CASE WHEN p_partkey % 5 = 0 THEN 'Zły slug' ELSE concat('b-', p_partkey) END AS slug", "CASE p_partkey % 3 WHEN 0 THEN 'V' WHEN 1 THEN '5' END AS tom")
    return df.select("p_partkey", R.valid_arguments(F.col("n"), F.col("speed"), F.col("slug"), F.col("tom")).alias("valid"))


@query("SELECT event_id AS line_no, event_type AS line FROM events ORDER BY event_id DESC LIMIT 200")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 lines of a log."""
    return R.last_lines(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("line")), 200)


@query(
    "SELECT p_partkey, array_to_string(list_filter(['convert', p_name, CASE WHEN p_size % 2 = 0 THEN '--optimize' END, CASE WHEN p_size % 2 = 0 THEN 'speed' END, "
    "CASE WHEN p_size % 5 > 1 THEN '--chunk-size' END, CASE WHEN p_size % 5 > 1 THEN p_size::VARCHAR END, CASE WHEN p_size % 3 = 0 THEN '--resume' END], lambda x: x IS NOT NULL), ' ') AS cmd FROM part"
)
def command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command's words, options only where there is a value."""
    size = F.col("p_size")
    options = {"--optimize": F.when(size % 2 == 0, F.lit("speed")), "--chunk-size": F.when(size % 5 > 1, size.cast("string")).when(size % 5 == 0, F.lit(""))}
    made = F.concat(F.array(F.lit("convert"), F.col("p_name")), R.command([], options, {"--resume": size % 3 == 0}))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(made, " ").alias("cmd"))


@query("SELECT o_orderkey, concat('book-', o_orderkey, '_', strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d')) AS folder FROM orders")
def dated_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", R.dated(F.concat(F.lit("book-"), F.col("o_orderkey").cast("string")), F.col("o_orderdate")).alias("folder"))
