"""Queries of lyrics, labels and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalframe.functions import texts as X
from tonalframe.operators import pages as P
from tonalframe.plans.registry import query
from tonalframe.sources.tables import table


@query(r"""
SELECT doc_id, line_no, regexp_replace(line, '[\s\p{Z}_,.?!，。？！、…—"''“”‘’（）()]', '', 'g') AS clean, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)""")
def lyric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without white space and punctuation."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", X.clean_lyrics(F.col("line")).alias("clean"), F.char_length("line").alias("n"))


@query()
def lyric_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a recogniser is likely to have made up: repeated pieces or few characters (P13); a backreference has no DuckDB form."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", X.repeated(F.col("line")).alias("repeated"), X.low_variety(F.col("line")).alias("low_variety"))


@query(r"""
SELECT doc_id, line_no, CASE WHEN n = 0 THEN 'silent' WHEN n >= 6 AND u / n < 0.35 THEN 'repetitive' WHEN contains(lower(line), 'license') THEN 'blacklist' WHEN w > 40 THEN 'implausible' ELSE 'accepted' END AS reason
FROM (SELECT doc_id, line, line_no, length(line) AS n, len(list_distinct(string_split(line, ''))) AS u, len(string_split(line, ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents))""")
def line_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to refuse a line."""
    line = F.col("line")
    reason = (
        F.when(F.char_length(line) == 0, "silent").when(X.low_variety(line), "repetitive").when(F.lower(line).contains("license"), "blacklist")
        .when(F.size(F.split(line, " ")) > 40, "implausible").otherwise("accepted")
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", reason.alias("reason"))


#: Letters of the tables' languages beyond ASCII, and control characters for them, for an engine that measures bytes.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
SIGNS = "".join(chr(k) for k in (*range(1, 9), *range(14, 27)))


@query("""
WITH folded AS (SELECT conv_id, turn, translate(text, '""" + LETTERS + """', '""" + SIGNS + """') AS text FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN greatest(length(a.text), length(b.text)) = 0 THEN 1.0 ELSE round_even(1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)), 6) END::DOUBLE AS similarity
FROM folded a JOIN folded b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity of neighbouring turns (X1, A7). The SQL's engine counts bytes, so there each letter beyond ASCII becomes a control character of its own."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    # Few bytes but much work a row: as many tasks as the session deals out.
    met = rows.join(following, ["conv_id", "turn"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return met.select("conv_id", "turn", F.bround(X.similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


NAMES = ["Intro", "Verse 1", "Pre-Chorus", "Chorus", "Bridge", "間奏", "Ending", "x", "预副歌", "pre chorus", "b", " ", "Example", "Hook"]
NAMED = ["intro", "verse", "prechorus", "chorus", "bridge", "interlude", "outro", "x", "prechorus", "prechorus", "B", "section", "section", "Hook"]
LABELS = f"SELECT conv_id, turn, {NAMES}[1 + (conv_id + turn) % 14] AS label FROM conversations"


@query(f"SELECT conv_id, turn, label, {NAMED}[1 + (conv_id + turn) % 14] AS role FROM ({LABELS})")
def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of section labels."""
    label = F.element_at(F.array(*map(F.lit, NAMES)), ((F.col("conv_id") + F.col("turn")) % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("label"), X.section_role(label).alias("role"))


@query("SELECT p_partkey AS id, TRY_CAST(regexp_extract(t, '[Cc]apo[: ]*([0-9]+)', 1) AS INTEGER) AS capo, nullif(regexp_extract(t, '[Kk]ey[: ]*([A-G][b#]?)', 1), '') AS key FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Capo: ' || p_size % 8 || ' Key: ' || list_value('C', 'F#', 'Bb')[1 + p_size % 3] WHEN 1 THEN 'key G, capo ' || p_size % 5 ELSE p_name END AS t FROM part)")
def capo_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capo and key read out of running text."""
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    key = F.element_at(F.array(*map(F.lit, ["C", "F#", "Bb"])), (n % 3 + 1).cast("int"))
    text = F.when(k == 0, F.concat(F.lit("Capo: "), n % 8, F.lit(" Key: "), key)).when(k == 1, F.concat(F.lit("key G, capo "), n % 5)).otherwise(F.col("p_name"))
    capo = F.nullif(F.regexp_extract(text, "[Cc]apo[: ]*([0-9]+)", 1), F.lit("")).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), capo.alias("capo"), F.nullif(F.regexp_extract(text, "[Kk]ey[: ]*([A-G][b#]?)", 1), F.lit("")).alias("key"))


@query(r"SELECT p_partkey AS id, regexp_replace(regexp_replace('夜曲 ' || p_name || ' / ' || p_type, '[^\p{L}\p{N}_-]', '_', 'g'), '_+', '_', 'g') AS name FROM part")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names without odd characters (X11)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.file_name(F.concat(F.lit("夜曲 "), "p_name", F.lit(" / "), "p_type")).alias("name"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.page') END AS page, event_id % 3 = 0 AS corrupt FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text, null where the text is cut off (X6's first pass)."""
    cut = F.col("event_id") % 3 == 0
    props = F.when(cut, F.expr("left(props, 3)")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(props), "$.page", "string").alias("page"), cut.alias("corrupt"))
    return rows


@query()
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-off JSON trimmed back to its last whole value and closed by its open brackets, null where nothing can be read."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("left(props, char_length(props) - event_id % 4)").alias("props"))
    return P.salvaged(rows, "props").withColumn("readable", F.try_parse_json("props").isNotNull())


@query()
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of text, without scripts and furniture."""
    return P.text_lines(table(spark, sf_dir, "pages"), "html")


@query(r"""
SELECT d.doc_id, d.a AS text_a, count(*) AS shared FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS a FROM documents) d JOIN (SELECT DISTINCT unnest(string_split(text, '')) AS a FROM benchmark) b USING (a) GROUP BY ALL""")
def shared_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that documents have in common with a reference; the same as all_shared_characters, which it now calls."""
    return all_shared_characters(spark, sf_dir)


@query(r"""
SELECT d.doc_id, d.a AS text_a, count(*) AS shared FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS a FROM documents) d JOIN (SELECT DISTINCT unnest(string_split(text, '')) AS a FROM benchmark) b USING (a) GROUP BY ALL""")
def all_shared_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that documents of any length have in common with a reference (W23's overlap)."""
    chars = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("text_a"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("text_a")).distinct()
    return chars.join(F.broadcast(known), "text_a").groupBy("doc_id", "text_a").agg(F.count(F.lit(1)).alias("shared"))
