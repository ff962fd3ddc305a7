"""Driver queries of the engine's own operators over the driver's tables, each with its SQL equivalent.

The corpus holds none of the marks that several rules look for, so such queries append them by key, in
the query and in the SQL alike (`_INJECT`, plain expressions that both engines read).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import scores, text
from folioforge.operators import asr, fusion, htr, ocr, reasoning, retrieval
from folioforge.plans import pipelines
from folioforge.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_INJECT = {
    "ocr": "text || CASE doc_id % 8 WHEN 0 THEN ' Sec. 13 and S.7, cl. 4 Art. 14 ' WHEN 1 THEN ' inter-\npretation | here ' WHEN 2 THEN ' fl “x” ‘y’\n\n\n\n\nz' WHEN 3 THEN 'x  \t y' ELSE '' END",
    "speech": "text || CASE doc_id % 7 WHEN 0 THEN ' under section 1 38 of n i act' WHEN 1 THEN ' section one thirty-eight high court' WHEN 2 THEN ' section  12 of i p c and c r p c' WHEN 3 THEN ' es see, supreme court r e r a' ELSE '' END",
    "meta": "text || CASE doc_id % 9 WHEN 0 THEN ' CONTRACT BETWEEN: Alpha Beta Ltd' WHEN 1 THEN ' notice dated 12/03/2021 at Mumbai' WHEN 2 THEN ' ORDER of the COURT, 5 march 2020' WHEN 3 THEN ' writ, April 7, 2019 in the high court' WHEN 4 THEN ' affidavit 31/02/2020, 1 May 2020' WHEN 5 THEN ' judgement versus Gamma Delta' ELSE '' END",
    "review": "text || CASE doc_id % 5 WHEN 0 THEN ' [REVIEW]doubtful ' || CAST(doc_id AS STRING) || '[/REVIEW] then [REVIEW] more[/REVIEW]' WHEN 1 THEN ' [UNCERTAIN] yes  no' WHEN 2 THEN ' [REVIEW] [/REVIEW]' ELSE '' END",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if it has one, its SQL."""

    def add(run: Query) -> Query:
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return add


def _injected(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_INJECT[kind]} AS text")


_WORD = r"[\p{L}\p{N}_]"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _sql_rules(expression: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        expression = f"regexp_replace({expression}, '{pattern}', '{replacement}', 'g')"
    return expression


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_TOKENS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


@query("sentence_split", f"SELECT doc_id, CAST(len({_SENTENCES.format('text')}) AS BIGINT) AS n_sentences, {_SENTENCES.format('text')}[1] AS first_sentence FROM documents")
def _(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@query("token_count", f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def _(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_tokens"))


@query("sentence_jaccard", f"""WITH s AS (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents),
t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(s[1]), '{_WORD}+')) AS a, list_distinct(regexp_extract_all(lower(s[2]), '{_WORD}+')) AS b FROM s WHERE len(s) > 1)
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM t""")
def _(spark, sf):
    s = _table(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("s")).where("size(s) > 1")
    both = s.select("doc_id", text.sentence_tokens(F.get("s", F.lit(0))).alias("a"), text.sentence_tokens(F.get("s", F.lit(1))).alias("b"))
    return both.select("doc_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_OCR_SQL = [(r"(\w+)-\n(\w+)", r"\1\2"), (r"(?i)\bS\.\s*(\d)", r"Section \1"), (r"(?i)\bSec\.\s*(\d)", r"Section \1"), (r"(?i)\bcl\.\s*(\d)", r"Clause \1"), (r"(?i)\bArt\.\s*(\d)", r"Article \1")]
_TAIL = [(r"\n{3,}", "\n\n"), (r"[ \t]+", " ")]


_PIPE = [(r"(^|\s)\|($|\s)", r"\1 \2")] * 2
_ISOLATED = [(r"(^|[^\p{L}\p{N}_])fl($|[^\p{L}\p{N}_])", r"\1fi\2")] * 2


def _quotes(expression: str) -> str:
    return f"replace(replace(replace(replace({expression}, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"')"


@query("ocr_normalise", "SELECT doc_id, " + _STRIP.format(_sql_rules(_quotes(_sql_rules(_INJECT["ocr"], [*_OCR_SQL, *_PIPE, *_ISOLATED])), _TAIL)) + " AS text FROM documents")
def _(spark, sf):
    return _injected(spark, sf, "ocr").select("doc_id", text.normalise_ocr(F.col("text")).alias("text"))


@query("htr_clean", "SELECT doc_id, " + _STRIP.format(_sql_rules("text || '  ' || chr(7) || ' x'", [(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")])) + " AS text FROM documents")
def _(spark, sf):
    return _table(spark, sf, "documents").selectExpr("doc_id", "text || '  ' || chr(7) || ' x' AS text").select("doc_id", text.clean_htr(F.col("text")).alias("text"))


_SPEECH_SQL = [
    (r"(?i)\bsection\s+1\s+38\b", "Section 138"), (r"(?i)\bsection\s+one\s+thirty[\s-]eight\b", "Section 138"), (r"\bsection\s+(\d+)\b", r"Section \1"), (r"(?i)\bes\s+see\b", "SC"),
    (r"(?i)\bhigh court\b", "High Court"), (r"(?i)\bsupreme court\b", "Supreme Court"), (r"(?i)\bi\s+p\s+c\b", "IPC"), (r"(?i)\bc\s+r\s+p\s+c\b", "CrPC"), (r"(?i)\bn\s+i\s+act\b", "NI Act"), (r"(?i)\br\s+e\s+r\s+a\b", "RERA"), (" {2,}", " "),
]


@query("asr_corrections", f"SELECT doc_id, {_sql_rules(_INJECT['speech'], _SPEECH_SQL)} AS text FROM documents")
def _(spark, sf):
    return _injected(spark, sf, "speech").select("doc_id", text.correct_speech(F.col("text")).alias("text"))


_FUSED = [(rf"({_WORD})\.({_WORD})", r"\1. \2"), (rf"({_WORD})\.({_WORD})", r"\1. \2"), (r"(?i)\b(Section|S\.?|Sec\.?)\s*(\d+)\b", r"Section \2")]


@query("clean_text", "SELECT doc_id, " + _STRIP.format(_sql_rules(_quotes(_sql_rules(_INJECT["ocr"], _FUSED)), [(r"[ \t]+", " "), (r" +\n", "\n"), (r"\n{3,}", "\n\n")])) + " AS text FROM documents")
def _(spark, sf):
    return fusion.nfkc(_injected(spark, sf, "ocr")).select("doc_id", text.clean_fused(F.col("text")).alias("text"))


def _whole(words: str) -> str:
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])"


_TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{_whole(p.replace(chr(92) + 'b', ''))}') THEN '{n}'" for n, p in (
    ("fir", "FIRST INFORMATION REPORT|FIR"), ("contract", "CONTRACT|AGREEMENT"), ("affidavit", "AFFIDAVIT"), ("court_order", "COURT ORDER|ORDER of the COURT"),
    ("judgment", "JUDGMENT|JUDGEMENT"), ("notice", "NOTICE"), ("deed", "DEED"), ("writ_petition", "WRIT PETITION|WRIT"))) + " END"


@query("doc_type", f"SELECT doc_id, {_TYPE_SQL} AS doc_type FROM (SELECT doc_id, {_INJECT['meta']} AS t FROM documents)")
def _(spark, sf):
    return _injected(spark, sf, "meta").select("doc_id", text.doc_type(F.col("text")).alias("doc_type"))


@query("parties", f"""WITH t AS (SELECT doc_id, {_INJECT['meta']} AS t FROM documents),
p AS (SELECT doc_id, list_transform(regexp_extract_all(t, '{text.PARTY.replace("(?Uis)", "(?is)")}', 1), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), ',+$', '')) AS p FROM t),
d AS (SELECT doc_id, list_filter(p, lambda x, i: x <> '' AND list_position(p, x) = i)[1:6] AS p FROM p)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_parties, array_to_string(p, '; ') AS parties FROM d""")
def _(spark, sf):
    return _injected(spark, sf, "meta").select("doc_id", text.parties(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n_parties"), F.array_join("p", "; ").alias("parties"))


_MONTHS = "|".join(text.MONTHS)
_MONTH_NO = "list_position(['" + "', '".join(m.lower() for m in text.MONTHS) + "'], lower({}))"


@query("doc_date", f"""WITH t AS (SELECT doc_id, {_INJECT['meta']} AS t FROM documents),
g AS (SELECT doc_id, regexp_extract(t, '\\b(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{4}})\\b', ['a', 'b', 'c']) AS n, regexp_extract(t, '(?i)\\b(\\d{{1,2}})\\s+({_MONTHS})\\s+(\\d{{4}})\\b', ['a', 'b', 'c']) AS d,
  regexp_extract(t, '(?i)\\b({_MONTHS})\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})\\b', ['a', 'b', 'c']) AS m FROM t)
SELECT doc_id, strftime(coalesce(try_cast(n.c || '-' || n.b || '-' || n.a AS DATE), try_cast(d.c || '-' || {_MONTH_NO.format('d.b')} || '-' || d.a AS DATE), try_cast(m.c || '-' || {_MONTH_NO.format('m.a')} || '-' || m.b AS DATE)), '%Y-%m-%d') AS date FROM g""")
def _(spark, sf):
    return _injected(spark, sf, "meta").select("doc_id", text.iso_date(F.col("text")).alias("date"))


@query("jurisdiction", f"SELECT doc_id, nullif(regexp_extract({_INJECT['meta']}, '(?i)({'|'.join(text.JURISDICTIONS)})', 1), '') AS jurisdiction FROM documents")
def _(spark, sf):
    return _injected(spark, sf, "meta").select("doc_id", text.jurisdiction(F.col("text")).alias("jurisdiction"))


def _intent_sql(t: str, questions: str, instructions: str) -> str:
    return f"CASE WHEN NOT regexp_matches({t}, '\\S') THEN 'unknown' WHEN contains({t}, '?') OR regexp_matches({t}, '{_whole(questions)}') THEN 'question' WHEN regexp_matches({t}, '{_whole(instructions)}') THEN 'instruction' ELSE 'narration' END"


@query("intent", f"SELECT conv_id, turn, {_intent_sql('t', text.QUESTION_SPEECH, text.INSTRUCTION_SPEECH)} AS speech_intent, {_intent_sql('t', text.QUESTION_FUSED, text.INSTRUCTION_FUSED)} AS fused_intent FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Draft a note. ' WHEN 1 THEN 'Would it? ' WHEN 2 THEN 'attach ' ELSE '' END || text AS t FROM conversations)")
def _(spark, sf):
    t = _table(spark, sf, "conversations").selectExpr("conv_id", "turn", "CASE turn % 4 WHEN 0 THEN 'Draft a note. ' WHEN 1 THEN 'Would it? ' WHEN 2 THEN 'attach ' ELSE '' END || text AS t")
    return t.select("conv_id", "turn", text.speech_intent(F.col("t")).alias("speech_intent"), text.fused_intent(F.col("t")).alias("fused_intent"))


@query("strip_markers", "SELECT doc_id, " + _sql_rules(_INJECT["review"], [(r"(?s)\[REVIEW\](.*?)\[/REVIEW\]", r"\1"), (r"\[UNCERTAIN\]", ""), (" {2,}", " ")]) + " AS text FROM documents")
def _(spark, sf):
    return _injected(spark, sf, "review").select("doc_id", text.strip_markers(F.col("text")).alias("text"))


@query("review_flags", f"SELECT document_id, modality, text, 'low_confidence' AS reason FROM (SELECT doc_id AS document_id, 'HTR' AS modality, unnest(list_transform(regexp_extract_all({_INJECT['review']}, '(?s)\\[REVIEW\\](.*?)\\[/REVIEW\\]', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS text FROM documents) WHERE text <> ''")
def _(spark, sf):
    return fusion.review_flags(_injected(spark, sf, "review").select(F.col("doc_id").alias("document_id"), F.lit("HTR").alias("source"), "text"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM pages")
def _(spark, sf):
    return _table(spark, sf, "pages").select("page_id", text.escape_html(F.col("html")).alias("safe"))


@query("legal_preserve", f"SELECT doc_id, regexp_matches(t, '\\b(IPC|CrPC|CPC|NI Act|IT Act|RERA|NCLT|NCLAT|SC|HC|DC)\\b') OR regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])S(ec(tion)?)?\\.?\\s*\\d+') OR regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,}}($|[^\\p{{L}}\\p{{N}}_])') OR regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])\\d[\\d/.-]*($|[^\\p{{L}}\\p{{N}}_])') AS preserved FROM (SELECT doc_id, {_INJECT['speech']} AS t FROM documents)")
def _(spark, sf):
    return _injected(spark, sf, "speech").select("doc_id", text.is_preserved(F.col("text")).alias("preserved"))


# Geometry and confidence: lineitem as boxes, an order as a page.
_BOX = "l_orderkey, l_linenumber, (l_suppkey % 10) * 90.0 AS x0, (l_partkey % 200) * 5.0 AS y0, (l_suppkey % 10) * 90.0 + 20 + l_quantity * 10 AS x1, (l_partkey % 200) * 5.0 + 10 + l_linenumber * 12 AS y1, l_discount * 1000 AS confidence"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*_BOX.replace(" AS ", "§").replace(", ", "\n").replace("§", " AS ").split("\n"))


@query("layout_class", f"""SELECT l_orderkey, l_linenumber, CASE WHEN y0 / 1000 >= 0.92 THEN 'footer' WHEN (y0 / 1000 < 0.05 OR y1 / 1000 > 0.92) AND x1 - x0 < 300 THEN 'page_number'
  WHEN y0 / 1000 < 0.20 AND (x1 - x0) / 1000 > 0.5 THEN 'heading' ELSE 'body' END AS block_type,
  CASE WHEN y0 / 1000 > 0.70 AND y1 - y0 < 120 AND (x1 - x0) / (y1 - y0) > 2 THEN 'signature' WHEN x1 - x0 < 300 AND y1 - y0 < 80 AND (x1 - x0) / (y1 - y0) > 0.3 AND (x1 - x0) / (y1 - y0) < 6 THEN 'table_fill'
  WHEN y1 - y0 < 60 AND (x1 - x0) / 1000 < 0.7 THEN 'annotation' WHEN (x1 - x0) * (y1 - y0) > 10000 THEN 'standalone_note' ELSE 'unknown' END AS hw_type
FROM (SELECT {_BOX} FROM lineitem)""")
def _(spark, sf):
    box = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    size = (F.lit(1000.0), F.lit(1000.0))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", scores.layout_class(*box, *size).alias("block_type"), scores.handwriting_class(*box, *size).alias("hw_type"))


@query("native_block_class", """SELECT doc_id, CASE WHEN y > 0.92 THEN 'footer' WHEN y < 0.05 AND length(t) < 50 THEN 'page_number' WHEN y < 0.20 AND length(t) < 200 AND t = upper(t) AND t <> lower(t) THEN 'heading'
  WHEN y < 0.20 AND length(t) < 100 THEN 'heading' ELSE 'body' END AS type FROM (SELECT doc_id, doc_id % 100 / 100.0 AS y, text AS t FROM documents)""")
def _(spark, sf):
    t = _table(spark, sf, "documents").selectExpr("doc_id", "CAST(doc_id % 100 AS DOUBLE) AS y0", "text AS t")
    return t.select("doc_id", scores.native_block_class(F.col("t"), F.col("y0"), F.lit(100.0)).alias("type"))


@query("reading_order", f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(y0 / 50), x0, l_linenumber) AS place FROM (SELECT {_BOX} FROM lineitem)")
def _(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(*scores.reading_order(F.col("y0"), F.col("x0")), "l_linenumber")
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("long").alias("place"))


_LINE_WORDS = "l_orderkey, l_linenumber * 10000000 + l_partkey AS pos, 'w' || CAST(l_partkey % 50 AS STRING) AS text, (l_partkey % 40) * 10.0 AS y0, (l_partkey % 40) * 10.0 + 12 AS y1"


@query("words_to_text", f"""WITH w AS (SELECT {_LINE_WORDS} FROM lineitem),
b AS (SELECT *, CASE WHEN y0 - lag(y1) OVER s > 8 THEN 1 ELSE 0 END AS b FROM w WINDOW s AS (PARTITION BY l_orderkey ORDER BY pos)),
n AS (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY pos) AS line FROM b),
l AS (SELECT l_orderkey, line, string_agg(text, ' ' ORDER BY pos) AS t FROM n GROUP BY ALL)
SELECT l_orderkey, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY l_orderkey""")
def _(spark, sf):
    words = _table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber * 10000000 + l_partkey AS pos", "'w' || CAST(l_partkey % 50 AS STRING) AS text", "(l_partkey % 40) * 10.0D AS y0", "(l_partkey % 40) * 10.0D + 12 AS y1")
    return ocr.words_to_text(words, ["l_orderkey"])


@query("low_confidence_pages", "SELECT l_suppkey AS document_id, CAST(len(p) AS BIGINT) AS n_pages, list_sum(p) AS page_sum FROM (SELECT l_suppkey, coalesce(list(page ORDER BY page) FILTER (WHERE m < 70), []) AS p FROM (SELECT l_suppkey, l_linenumber AS page, avg(l_discount * 1000 + l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_suppkey)")
def _(spark, sf):
    blocks = _table(spark, sf, "lineitem").selectExpr("l_suppkey AS document_id", "l_linenumber AS page", "l_discount * 1000 + l_quantity AS confidence")
    pages = ocr.low_confidence_pages(blocks)
    return pages.select("document_id", F.size("low_confidence_pages").cast("long").alias("n_pages"), F.when(F.size("low_confidence_pages") > 0, F.aggregate("low_confidence_pages", F.lit(0).cast("long"), lambda a, b: a + b)).alias("page_sum"))


@query("logprob_confidence", "SELECT event_id, round(greatest(0.0, least(100.0, (1 - value / 4 / 25) * 100)), 6) AS confidence, greatest(0.0, least(100.0, (1 - value / 4 / 25) * 100)) < 70 AS review_required FROM events")
def _(spark, sf):
    c = scores.logprob_confidence(-F.col("value") / 25)
    return _table(spark, sf, "events").select("event_id", F.round(c, 6).alias("confidence"), scores.review_required(c).alias("review_required"))


@query("token_confidence", "SELECT l_orderkey, coalesce(round(least(100.0, exp(avg(ln(CASE WHEN l_discount > 0 THEN l_discount * 10 END))) * 100), 2), 0.0) AS confidence FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    return _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(scores.token_confidence_agg(F.col("l_discount") * 10).alias("confidence"))


@query("nms", f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, l_linenumber, x0, y0, x1, y1) AS k FROM (SELECT {_BOX} FROM lineitem)),
s(l_orderkey, k, kept) AS (SELECT l_orderkey, 1::BIGINT, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n': l_linenumber}}] FROM b WHERE k = 1
 UNION ALL SELECT s.l_orderkey, b.k, CASE WHEN len(list_filter(s.kept, lambda r: greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0))
   > 0.3 * ((r.x1 - r.x0) * (r.y1 - r.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0))))) > 0
   THEN s.kept ELSE list_append(s.kept, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'n': b.l_linenumber}}) END FROM s JOIN b ON b.l_orderkey = s.l_orderkey AND b.k = s.k + 1)
SELECT l_orderkey, CAST(len(kept) AS BIGINT) AS n_kept, CAST(list_sum(list_transform(kept, lambda r: r.n)) AS BIGINT) AS lines FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) = 1""")
def _(spark, sf):
    boxes = _boxes(spark, sf)  # an order is a page
    one = F.struct("l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.col("confidence").alias("score"))
    pages = boxes.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("r")).select("l_orderkey", htr.suppress_overlaps(F.col("r")).alias("kept"))
    return pages.select("l_orderkey", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, k: a + k["l_linenumber"]).alias("lines"))


@query("merge_blocks", """WITH b AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id AS document_id, regexp_replace(coalesce(string_agg(CASE role WHEN 'system' THEN chr(10) || chr(10) || t || chr(10) ELSE t END, chr(10) ORDER BY turn) FILTER (WHERE t <> '' AND turn % 5 <> 4), ''), '^\\s+|\\s+$', '', 'g') AS full_text FROM b GROUP BY conv_id""")
def _(spark, sf):
    kind = "CASE WHEN turn % 5 = 4 THEN 'footer' WHEN role = 'system' THEN 'heading' ELSE 'body' END AS type"
    return ocr.merge_blocks(_table(spark, sf, "conversations").selectExpr("conv_id AS document_id", "1 AS page", "turn AS pos", kind, "text"))


@query("fullpage_fallback", "SELECT o_orderkey, CAST(coalesce(x0, 0) AS DOUBLE) AS x0, CAST(coalesce(x1, 1000) AS DOUBLE) AS x1, coalesce(block_type, 'body') AS block_type FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey % 90 AS x0, l_partkey % 90 + 50 AS x1, 'heading' AS block_type FROM lineitem WHERE l_linenumber = 2) ON o_orderkey = l_orderkey")
def _(spark, sf):
    pages = _table(spark, sf, "orders").selectExpr("o_orderkey", "1000.0D AS width", "1000.0D AS height")
    regions = _table(spark, sf, "lineitem").where("l_linenumber = 2").selectExpr("l_orderkey AS o_orderkey", "CAST(l_partkey % 90 AS DOUBLE) AS x0", "0.0D AS y0", "CAST(l_partkey % 90 + 50 AS DOUBLE) AS x1", "9.0D AS y1", "'heading' AS block_type", "90.0D AS confidence")
    return ocr.regions_or_full_page(pages, regions, ["o_orderkey"]).select("o_orderkey", "x0", "x1", "block_type")


_SEGMENTS = "event_id AS segment_id, user_id AS document_id, (event_id % 11) / 10.0 AS no_speech_prob, -value / 40 AS avg_logprob, '  ' || event_type || ' section  ' || CAST(event_id % 300 AS STRING) || ' high court' AS text"


@query("asr_transcript", f"""WITH s AS (SELECT document_id, segment_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), ' +', ' ', 'g'), 'section (\\d+)', 'Section \\1', 'g'), 'high court', 'High Court', 'g'), '^ +', '') AS t,
 greatest(0.0, least(100.0, (1 + avg_logprob / 4) * 100)) AS c FROM (SELECT {_SEGMENTS} FROM events) WHERE no_speech_prob <= 0.6)
SELECT document_id, string_agg(CASE WHEN c < 70 THEN '[REVIEW]' || t || '[/REVIEW]' ELSE t END, ' ' ORDER BY segment_id) AS transcript, count(*) FILTER (WHERE c < 70) AS low_confidence_segments, floor(avg(c)) AS mean_confidence, 'narration' AS intent FROM s GROUP BY document_id""")
def _(spark, sf):
    segments = _table(spark, sf, "events").selectExpr("event_id AS segment_id", "user_id AS document_id", "(event_id % 11) / 10.0D AS no_speech_prob", "-value / 40 AS avg_logprob", "'  ' || event_type || ' section  ' || CAST(event_id % 300 AS STRING) || ' high court' AS text")
    return asr.assemble_transcript(asr.process_segments(segments)).withColumn("mean_confidence", F.floor("mean_confidence").cast("double"))


@query("htr_assemble", "SELECT conv_id AS document_id, coalesce(string_agg(CASE WHEN turn * 17 % 100 < 70 THEN '[REVIEW]' || t || '[/REVIEW]' ELSE t END, chr(10) ORDER BY turn) FILTER (WHERE t <> ''), '') AS full_text, count(*) FILTER (WHERE turn * 17 % 100 < 70) AS low_confidence_regions, round(avg(turn * 17 % 100), 6) AS mean_confidence FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) GROUP BY conv_id")
def _(spark, sf):
    regions = _table(spark, sf, "conversations").selectExpr("conv_id AS document_id", "turn AS pos", "text", "CAST(turn * 17 % 100 AS DOUBLE) AS confidence", "turn * 17 % 100 < 70 AS review_required")
    return htr.assemble_text(regions).withColumn("mean_confidence", F.round("mean_confidence", 6))


_DICT = "SELECT DISTINCT lower(event_type) AS term, 5 AS frequency FROM events"


@query("spell_correct", """WITH w AS (SELECT DISTINCT substr(event_type, 1, 2) || substr(event_type, 4) AS word FROM events UNION SELECT DISTINCT event_type FROM events UNION SELECT 'zzzzzz'),
d AS (SELECT DISTINCT event_type AS term FROM events),
c AS (SELECT word, term, levenshtein(word, term) AS k, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), term) AS r FROM w JOIN d ON levenshtein(word, term) <= 1)
SELECT w.word, coalesce(c.term, w.word) AS corrected FROM w LEFT JOIN c ON w.word = c.word AND r = 1""")
def _(spark, sf):
    events = _table(spark, sf, "events").select("event_type").distinct()
    words = events.selectExpr("substr(event_type, 1, 2) || substr(event_type, 4) AS word").union(events).union(spark.sql("SELECT 'zzzzzz'")).distinct()
    return htr.correct_words(words, events.selectExpr("event_type AS term", "5 AS frequency"))


# Fusion: four documents make one, one modality each.
def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    expressions = ("doc_id DIV 4 AS document_id", "element_at(array('OCR', 'HTR', 'ASR', 'TYPED'), CAST(doc_id % 4 AS INT) + 1) AS source", "text", "lang AS language", "CAST(NULL AS STRING) AS intent")
    return _table(spark, sf, "documents").selectExpr(*expressions)


@query("language_vote", """SELECT document_id, lang AS primary_language FROM (SELECT doc_id // 4 AS document_id, lang, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY sum(CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END) DESC, min(doc_id % 4)) AS k FROM documents GROUP BY 1, 2) WHERE k = 1""")
def _(spark, sf):
    return fusion.language_vote(_blocks(spark, sf))


_FOLD = f"""WITH s AS (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents),
t AS (SELECT doc_id, list_transform(s, lambda x: {{'s': x, 't': list_distinct(regexp_extract_all(lower(x), '{_WORD}+'))}}) AS s FROM s),
f AS (SELECT doc_id, list_reduce(s, lambda st, x: list_append(st, {{'s': x.s, 't': CASE WHEN len(x.t) > 0 AND len(list_filter(st, lambda y: len(y.t) > 0 AND len(y.t) >= 0.85 * len(x.t) AND len(x.t) >= 0.85 * len(y.t)
  AND 1.85 * len(list_intersect(x.t, y.t)) >= 0.85 * (len(x.t) + len(y.t)) - 1e-9)) > 0 THEN NULL ELSE x.t END}}), []::STRUCT(s VARCHAR, t VARCHAR[])[]) AS r FROM t),
o AS (SELECT doc_id, list_transform(list_filter(r, lambda y: y.t IS NOT NULL), lambda y: y.s) AS o FROM f)
SELECT doc_id, CAST(len(o) AS BIGINT) AS n_kept, array_to_string(o, ' ') AS text FROM o"""


@query("dedup_sentences", _FOLD)
def _(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", fusion.drop_repeated_sentences(F.array("text")).alias("t"))
    return docs.select("doc_id", F.get("t", F.lit(0)).alias("text")).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_kept"), "text")


@query("fuse_full")
def _(spark, sf):
    fused = fusion.fuse(_blocks(spark, sf))
    return fused.select("document_id", "primary_language", "detected_intent", "total_word_count", "fused_text", fusion.for_rag(F.col("fused_text")).alias("rag_text"), fusion.for_llm().alias("llm_text"), F.size("review_flags").alias("n_flags"))


@query("fuse_plain", f"""WITH b AS (SELECT doc_id // 4 AS document_id, doc_id % 4 AS r, lang, {_STRIP.format(_sql_rules('text', [*_FUSED, (r'[ \t]+', ' '), (r' +\n', chr(10)), (r'\n{3,}', chr(10) * 2)]))} AS t FROM documents),
k AS (SELECT * FROM b WHERE length(t) >= 3),
g AS (SELECT document_id, ['OCR-DOCUMENT', 'HTR-HANDWRITING', 'ASR-VOICE', 'TYPED-INPUT'] AS tags, list(r ORDER BY r) AS rs, string_agg('[' || ['OCR-DOCUMENT', 'HTR-HANDWRITING', 'ASR-VOICE', 'TYPED-INPUT'][r + 1] || ']' || chr(10) || t || chr(10) || '[/' || ['OCR-DOCUMENT', 'HTR-HANDWRITING', 'ASR-VOICE', 'TYPED-INPUT'][r + 1] || ']', chr(10) || chr(10) ORDER BY r) AS fused_text FROM k GROUP BY document_id)
SELECT document_id, fused_text, regexp_replace(regexp_replace(fused_text, '\\[/?(OCR-DOCUMENT|HTR-HANDWRITING|ASR-VOICE|TYPED-INPUT)\\]\\n?', '', 'g'), '^\\s+|\\s+$', '', 'g') AS rag_text, CAST(len({_TOKENS.format('fused_text')}) AS BIGINT) AS total_word_count FROM g""")
def _(spark, sf):
    fused = fusion.fuse(_blocks(spark, sf), deduplicate=False)
    return fused.select("document_id", "fused_text", fusion.for_rag(F.col("fused_text")).alias("rag_text"), "total_word_count")


# Chunks, vectors, answers.
def _plain_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("rag_text"), F.col("text").alias("fused_text"))


_WINDOWS = f"""WITH s AS (SELECT doc_id AS document_id, list_transform({_SENTENCES.format('text')}, lambda x: len({_TOKENS.format('x')})) AS n FROM documents),
c AS (SELECT document_id, list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)) AS c FROM s WHERE len(n) > 0),
w AS (SELECT document_id, c, list_reduce(range(1, len(c)), lambda st, i: CASE WHEN i > st.a AND c[i + 1] - c[st.a] > {{size}} THEN {{'a': list_filter(range(st.a, i + 1), lambda j: c[i] - c[j] <= {{overlap}})[1], 'w': list_append(st.w, {{'first': st.a, 'last': i - 1}})}} ELSE st END, {{'a': 1::BIGINT, 'w': []::STRUCT("first" BIGINT, "last" BIGINT)[]}}) AS r FROM c),
x AS (SELECT document_id, c, list_append(r.w, {{'first': r.a, 'last': len(c) - 1}}) AS w FROM w),
u AS (SELECT document_id, c, unnest(w) AS win, generate_subscripts(w, 1) - 1 AS window_index FROM x)"""


def _windows_sql(size: int, overlap: int) -> str:
    return _WINDOWS.replace("{size}", str(size)).replace("{overlap}", str(overlap))


@query("chunk_windows", _windows_sql(100, 20) + " SELECT document_id, CAST(window_index AS INT) AS window_index, CAST(win.first AS INT) AS first, CAST(win.last AS INT) AS last, CAST(c[win.last + 1] - c[win.first] AS INT) AS n_tokens FROM u")
def _(spark, sf):
    return retrieval.chunk_windows(_plain_documents(spark, sf), 100, 20)


@query("chunks", _windows_sql(512, 64) + """, k AS (SELECT document_id, window_index, c[win.last + 1] - c[win.first] AS n, window_index = max(window_index) OVER (PARTITION BY document_id) AS tail FROM u),
m AS (SELECT document_id, CASE WHEN tail AND n < 32 THEN -1 ELSE window_index END AS g, n, tail FROM k WHERE tail OR n >= 32),
o AS (SELECT document_id, n, tail, CASE WHEN g = -1 THEN max(g) FILTER (WHERE g >= 0) OVER (PARTITION BY document_id) ELSE g END AS g FROM m)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY g) - 1 AS INT) AS chunk_index, CAST(sum(n) AS INT) AS n_tokens FROM o WHERE g IS NOT NULL GROUP BY document_id, g""")
def _(spark, sf):
    return retrieval.chunk(_plain_documents(spark, sf)).select("document_id", "chunk_index", "n_tokens")


@query("chunk_modality")
def _(spark, sf):
    fused = fusion.fuse(_blocks(spark, sf)).select("document_id", fusion.for_rag(F.col("fused_text")).alias("rag_text"), "fused_text")
    both = [retrieval.chunk(fused, retrieval.ChunkRules(100, 20, 5, mode)).withColumn("mode", F.lit(mode)) for mode in ("reference", "interval")]
    return both[0].unionByName(both[1]).groupBy("mode", "source_modality").agg(F.count("*").alias("n_chunks"))


@query("hash_embedding", """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), v AS (SELECT doc_id, list_transform(range(0, 128), lambda i: ('0x' || substr(h, 2 * (i % 32) + 1, 2))::INT / 255.0::DOUBLE - 0.5) AS v FROM h),
u AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v)
SELECT doc_id, round(v[1], 6) AS first, round(v[32], 6) AS last, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm FROM u""")
def _(spark, sf):
    v = _table(spark, sf, "documents").select("doc_id", scores.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 32), 6).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings"


@query("cosine", f"WITH e AS ({_VECTORS}) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(scores.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "embedding", "label")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("knn", f"""WITH e AS ({_VECTORS}), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS s FROM e q, e WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(s, 6) AS score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS k FROM p) WHERE k <= 5""")
def _(spark, sf):
    return retrieval.knn(_entries(spark, sf), _questions(spark, sf), 5).withColumn("score", F.round("score", 6))


@query("ann_knn")
def _(spark, sf):
    return retrieval.approximate_knn(_entries(spark, sf), _questions(spark, sf), 5, planes=4, tables=24)


@query("retrieve_min_score", f"""WITH e AS ({_VECTORS}), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, list_cosine_similarity(q.v, e.v) AS s FROM e q, e WHERE q.vec_id % 50 = 0)
SELECT query_id, id, label, round(greatest(0, s), 4) AS score, CAST(k AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS k FROM p) WHERE k <= 5 AND round(greatest(0, s), 4) >= 0.3""")
def _(spark, sf):
    return retrieval.retrieve(_entries(spark, sf), _questions(spark, sf), 5, use_mmr=False, min_score=0.3).select("query_id", "id", "label", "score", "position")


@query("mmr")
def _(spark, sf):
    return retrieval.retrieve(_entries(spark, sf), _questions(spark, sf), 5).select("query_id", "id", F.round("score", 4).alias("score"), F.col("position").cast("int").alias("position"))


@query("store_upsert", "SELECT 'c' || CAST(label % 2 AS STRING) AS collection, count(*) AS n, CAST(sum(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS replaced FROM embeddings GROUP BY 1")
def _(spark, sf):
    from folioforge.sources.store import upserted

    first = _table(spark, sf, "embeddings").selectExpr("'c' || CAST(label % 2 AS STRING) AS collection", "vec_id AS chunk_id", "vec_id AS seq", "0 AS version")
    second = first.where("chunk_id % 3 = 0").selectExpr("collection", "chunk_id", "seq", "1 AS version")
    return upserted(first, second).groupBy("collection").agg(F.count("*").alias("n"), F.sum("version").cast("long").alias("replaced"))


@query("hydrate", "SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    return _table(spark, sf, "documents").select("doc_id").join(_table(spark, sf, "labels"), "doc_id").select("doc_id", "quality", "toxic")


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    context = "'[CONTEXT]\\n\\n[1] source=OCR score=0.923\\n' || text || '\\n\\n[2] source=ASR score=0.871\\nsecond\\nline\\n\\n[/CONTEXT]' AS retrieval_context"
    ask = "CASE item_id % 3 WHEN 0 THEN 'What does section 138 say of a cheque? ' WHEN 1 THEN ' Is it fraud under 420?' ELSE '' END || text AS query"
    return _table(spark, sf, "benchmark").selectExpr("item_id AS query_id", ask, "'' AS fused_document_text", context, "1024 AS max_tokens")


_PROMPTS = "SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'What does section 138 say of a cheque? ' WHEN 1 THEN ' Is it fraud under 420?' ELSE '' END || text AS query, '[CONTEXT]' || chr(10) || chr(10) || '[1] source=OCR score=0.923' || chr(10) || text || chr(10) || chr(10) || '[2] source=ASR score=0.871' || chr(10) || 'second' || chr(10) || 'line' || chr(10) || chr(10) || '[/CONTEXT]' AS ctx, text AS body FROM benchmark"


@query("user_prompt", f"SELECT query_id, ctx || chr(10) || chr(10) || '[LEGAL QUERY]' || chr(10) || regexp_replace(query, '^\\s+|\\s+$', '', 'g') || chr(10) || '[/LEGAL QUERY]' || chr(10) || chr(10) || '{reasoning.INSTRUCTION}' AS prompt FROM ({_PROMPTS})")
def _(spark, sf):
    return _prompts(spark, sf).select("query_id", reasoning.user_prompt(F.col("query"), F.col("fused_document_text"), F.col("retrieval_context")).alias("prompt"))


@query("parse_context", f"SELECT query_id, 1 AS n, 'OCR' AS source_modality, 0.923 AS score, substr(regexp_replace(regexp_replace(replace(replace(body, chr(13), ' '), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), ' $', ''), 1, 200) AS text_excerpt FROM ({_PROMPTS}) UNION ALL SELECT query_id, 2, 'ASR', 0.871, 'second line' FROM ({_PROMPTS})")
def _(spark, sf):
    return reasoning.parse_context(_prompts(spark, sf))


@query("mock_answer", f"""SELECT query_id, CASE WHEN p LIKE '%138%' OR p LIKE '%cheque%' THEN 'cheque' WHEN p LIKE '%420%' OR p LIKE '%cheat%' OR p LIKE '%fraud%' THEN 'cheating' ELSE 'other' END AS kind, 85.0 AS confidence, 1 AS n_citations, true AS is_grounded, false AS review_required FROM (SELECT query_id, lower(query) AS p FROM ({_PROMPTS}))""")
def _(spark, sf):
    answers, _ = reasoning.reason(_prompts(spark, sf))
    kind = F.when(F.col("answer_text") == reasoning.CHEQUE_ANSWER, "cheque").when(F.col("answer_text") == reasoning.CHEATING_ANSWER, "cheating").otherwise("other")
    return answers.select("query_id", kind.alias("kind"), "confidence", F.col("n_citations").cast("int").alias("n_citations"), "is_grounded", "review_required")


@query("citation_blocks", """WITH c AS (SELECT l_orderkey AS query_id, l_linenumber * 10000000 + l_partkey AS n, 'c' || CAST(l_suppkey % 4 AS STRING) AS chunk_id, round(l_discount * 10, 2) AS s FROM lineitem),
b AS (SELECT *, min(n) OVER (PARTITION BY query_id, chunk_id) AS f, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY s DESC, n) AS k FROM c)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, f) AS INT) AS index, chunk_id, s AS relevance_score FROM b WHERE k = 1""")
def _(spark, sf):
    cites = _table(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", "l_linenumber * 10000000 + l_partkey AS n", "'c' || CAST(l_suppkey % 4 AS STRING) AS chunk_id", "round(l_discount * 10, 2) AS relevance_score", "'OCR' AS source_modality", "'excerpt' AS text_excerpt")
    return reasoning.citation_blocks(cites).select("query_id", "index", "chunk_id", "relevance_score")


@query("render")
def _(spark, sf):
    return reasoning.format_answers(*reasoning.reason(_prompts(spark, sf)))


@query("stream_windows", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    from folioforge.streaming.ingest import hourly

    return hourly(_table(spark, sf, "events"))


@query("end_to_end")
def _(spark, sf):
    return pipelines.answer_questions(spark, sf)


# Wholes of several steps, with SQL of their own.
_FUSE_STEPS = f"""b AS (SELECT doc_id // 4 AS document_id, doc_id % 4 AS r, lang, {_STRIP.format(_sql_rules('text', [*_FUSED, (r'[ \t]+', ' '), (r' +\n', chr(10)), (r'\n{3,}', chr(10) * 2)]))} AS t FROM documents),
k AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n_blocks FROM b WHERE length(t) >= 3),
x AS (SELECT document_id, r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT document_id, r, {_SENTENCES.format('t')} AS s FROM k)),
l AS (SELECT document_id, list({{'r': r, 's': s, 't': list_distinct(regexp_extract_all(lower(s), '{_WORD}+'))}} ORDER BY r, i) AS s FROM x GROUP BY document_id),
f AS (SELECT document_id, list_reduce(s, lambda st, x: list_append(st, {{'r': x.r, 's': x.s, 't': CASE WHEN len(x.t) > 0 AND len(list_filter(st, lambda y: len(y.t) > 0 AND len(y.t) >= 0.85 * len(x.t) AND len(x.t) >= 0.85 * len(y.t)
  AND 1.85 * len(list_intersect(x.t, y.t)) >= 0.85 * (len(x.t) + len(y.t)) - 1e-9)) > 0 THEN NULL ELSE x.t END}}), []::STRUCT(r BIGINT, s VARCHAR, t VARCHAR[])[]) AS l FROM l),
u AS (SELECT document_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM f),
j AS (SELECT document_id, e.r AS r, string_agg(e.s, ' ' ORDER BY i) AS t FROM u WHERE e.t IS NOT NULL GROUP BY 1, 2),
m AS (SELECT k.document_id, k.r, k.lang, CASE WHEN k.n_blocks < 2 THEN k.t ELSE coalesce(j.t, '') END AS t FROM k LEFT JOIN j ON k.document_id = j.document_id AND k.r = j.r),
v AS (SELECT document_id, lang, row_number() OVER (PARTITION BY document_id ORDER BY sum(CASE WHEN r = 2 THEN 2 ELSE 1 END) DESC, min(r)) AS p FROM m GROUP BY 1, 2),
g AS (SELECT document_id, string_agg('[' || ['OCR-DOCUMENT', 'HTR-HANDWRITING', 'ASR-VOICE', 'TYPED-INPUT'][r + 1] || ']' || chr(10) || t || chr(10) || '[/' || ['OCR-DOCUMENT', 'HTR-HANDWRITING', 'ASR-VOICE', 'TYPED-INPUT'][r + 1] || ']', chr(10) || chr(10) ORDER BY r) AS fused_text,
  string_agg(['OCR', 'HTR', 'ASR', 'TYPED'][r + 1], ', ' ORDER BY r) FILTER (WHERE t <> '') AS sources FROM m GROUP BY document_id),
w AS (SELECT g.*, v.lang AS primary_language, CAST(len({_TOKENS.format('fused_text')}) AS BIGINT) AS total_word_count, {_intent_sql('fused_text', text.QUESTION_FUSED, text.INSTRUCTION_FUSED)} AS detected_intent FROM g JOIN v USING (document_id) WHERE v.p = 1)"""


@query("fuse_dedup", f"""WITH {_FUSE_STEPS}
SELECT document_id, primary_language, detected_intent, total_word_count, fused_text,
  '[LEGAL-AI CONTEXT]' || chr(10) || 'Language: ' || primary_language || chr(10) || 'Intent: ' || detected_intent || chr(10) || 'Sources: ' || coalesce(sources, '') || chr(10) || 'Word count: ' || total_word_count || chr(10) || 'Review flags: 0' || chr(10) || '[/LEGAL-AI CONTEXT]' || chr(10) || chr(10) || fused_text AS llm_text FROM w""")
def _(spark, sf):
    fused = fusion.fuse(_blocks(spark, sf))
    return fused.select("document_id", "primary_language", "detected_intent", "total_word_count", "fused_text", fusion.for_llm().alias("llm_text"))


@query("modality_blocks", f"""WITH {_FUSE_STEPS}
SELECT document_id, ['OCR', 'HTR', 'ASR', 'TYPED'][r + 1] AS source, t AS text, lang AS language, CAST(len({_TOKENS.format('t')}) AS BIGINT) AS word_count, contains(t, '[REVIEW]') AS has_review_flags FROM m""")
def _(spark, sf):
    return fusion.fuse(_blocks(spark, sf)).select("document_id", F.inline("modalities")).withColumn("word_count", F.col("word_count").cast("long"))


_REVIEWED = _INJECT["review"]


@query("chunk_texts", _windows_sql(100, 20).replace("FROM documents", f"FROM (SELECT doc_id, {_REVIEWED} AS text FROM documents)") + f""", d AS (SELECT doc_id AS document_id, {_SENTENCES.format('text')} AS s FROM (SELECT doc_id, {_REVIEWED} AS text FROM documents)),
k AS (SELECT document_id, window_index, array_to_string(list_slice(s, win.first, win.last), ' ') AS t, c[win.last + 1] - c[win.first] AS n, window_index = max(window_index) OVER (PARTITION BY document_id) AS tail FROM u JOIN d USING (document_id)),
m AS (SELECT document_id, window_index, t, CASE WHEN tail AND n < 5 THEN -1 ELSE window_index END AS g, tail FROM k WHERE tail OR n >= 5),
o AS (SELECT document_id, window_index, t, CASE WHEN g = -1 THEN max(g) FILTER (WHERE g >= 0) OVER (PARTITION BY document_id) ELSE g END AS g FROM m),
p AS (SELECT document_id, g, string_agg(t, ' ' ORDER BY window_index) AS text FROM o WHERE g IS NOT NULL GROUP BY 1, 2)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY g) - 1 AS INT) AS chunk_index, text, contains(text, '[REVIEW]') AS has_review_flag, sha256(CAST(document_id AS VARCHAR) || '|' || CAST(row_number() OVER (PARTITION BY document_id ORDER BY g) - 1 AS VARCHAR)) AS chunk_id FROM p""")
def _(spark, sf):
    docs = _injected(spark, sf, "review").select(F.col("doc_id").alias("document_id"), F.col("text").alias("rag_text"), F.col("text").alias("fused_text"))
    return retrieval.chunk(docs, retrieval.ChunkRules(100, 20, 5)).select("document_id", "chunk_index", "text", "has_review_flag", "chunk_id")


_NEAR = f"""WITH RECURSIVE e AS ({_VECTORS}), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS c FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, id, round(greatest(0, c), 4) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, id) AS k FROM p),
n AS (SELECT query_id, id, s, k FROM r WHERE k <= 15),
near AS (SELECT a.query_id, a.k AS a, b.k AS b, list_cosine_similarity(x.v, y.v) AS c FROM n a JOIN n b USING (query_id) JOIN e x ON x.vec_id = a.id JOIN e y ON y.vec_id = b.id),
step(query_id, position, chosen, k) AS (
  SELECT query_id, 1, [k], k FROM (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY 0.5 * s DESC, k) AS z FROM n) WHERE z = 1
  UNION ALL
  SELECT query_id, position + 1, list_append(chosen, k), k FROM (
    SELECT t.query_id, t.position, t.chosen, n.k, row_number() OVER (PARTITION BY t.query_id ORDER BY 0.5 * any_value(n.s) - 0.5 * max(near.c) DESC, n.k) AS z
    FROM step t JOIN n ON n.query_id = t.query_id AND NOT list_contains(t.chosen, n.k) JOIN near ON near.query_id = t.query_id AND near.a = n.k AND list_contains(t.chosen, near.b)
    WHERE t.position < 5 GROUP BY t.query_id, t.position, t.chosen, n.k) WHERE z = 1)"""


@query("mmr_order", f"{_NEAR} SELECT step.query_id, n.id, n.s AS score, CAST(position AS INT) AS position FROM step JOIN n ON n.query_id = step.query_id AND n.k = step.k")
def _(spark, sf):
    return retrieval.retrieve(_entries(spark, sf), _questions(spark, sf), 5).select("query_id", "id", F.round("score", 4).alias("score"), F.col("position").cast("int").alias("position"))


@query("ann_recall", "SELECT count(*) AS n_queries, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, sf):
    """Recall of the approximate search against the exact one, over every row whose id is divisible by 50."""
    exact = retrieval.knn(_entries(spark, sf), _questions(spark, sf), 5).select("query_id", "id")
    found = retrieval.approximate_knn(_entries(spark, sf), _questions(spark, sf), 5, planes=4, tables=24).select("query_id", "id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), (F.count("found") >= 0.9 * F.count("*")).alias("recall_of_nine_tenths"))


_ANSWERS = {"cheque": reasoning.CHEQUE_ANSWER, "cheating": reasoning.CHEATING_ANSWER, "other": reasoning.OTHER_ANSWER.replace("[UNCERTAIN]", "")}
_QUOTED = {name: answer.replace("'", "''") for name, answer in _ANSWERS.items()}
_CLAIMS = f"""WITH q AS (SELECT query_id, lower(query) AS p, substr(regexp_replace(regexp_replace(replace(replace(body, chr(13), ' '), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), ' $', ''), 1, 200) AS x FROM ({_PROMPTS})),
a AS (SELECT query_id, CASE WHEN p LIKE '%138%' OR p LIKE '%cheque%' THEN '{_QUOTED["cheque"]}' WHEN p LIKE '%420%' OR p LIKE '%cheat%' OR p LIKE '%fraud%' THEN '{_QUOTED["cheating"]}' ELSE '{_QUOTED["other"]}' END AS answer,
  CASE WHEN length(x) > 150 THEN regexp_replace(substr(x, 1, 150), '\\s+$', '') || '...' ELSE x END AS x FROM q),
h AS (SELECT *, {{0}} AS safe_answer, {{1}} AS safe_x FROM a)"""


def _escaped_sql(expression: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        expression = f"replace({expression}, '{raw}', '{safe}')"
    return expression


@query("render_text", _CLAIMS.replace("{0}", f"replace(replace({_escaped_sql('answer')}, chr(10) || chr(10), '</p><p>'), chr(10), '<br>')").replace("{1}", _escaped_sql("x")) + """
SELECT query_id, answer,
  '## Legal AI Answer' || chr(10) || chr(10) || answer || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || chr(10) || '[1] **OCR** (score: 0.923): _' || x || '_' || chr(10) || chr(10) || chr(10) || '---' || chr(10) || '*Confidence: 85.0% | Grounded: Yes | Language: en*' AS markdown,
  'ANSWER' || chr(10) || repeat('=', 60) || chr(10) || answer || chr(10) || chr(10) || 'CITATIONS' || chr(10) || repeat('-', 40) || chr(10) || '[1] OCR (score: 0.923): ' || x || chr(10) || chr(10) || 'Confidence: 85.0% | Grounded: Yes' AS plain,
  '<html><body>' || chr(10) || '<h2>Legal AI Answer</h2><p>' || safe_answer || '</p>' || chr(10) || '<h3>Citations</h3><ol>' || chr(10) || '<li><strong>[1]</strong> <em>OCR</em> (score: 0.923): ' || safe_x || '</li>' || chr(10) || '</ol>' || chr(10) || '<p><em>Confidence: 85.0% | Grounded: Yes</em></p>' || chr(10) || '</body></html>' AS html
FROM h""")
def _(spark, sf):
    return reasoning.format_answers(*reasoning.reason(_prompts(spark, sf))).select("query_id", "answer", "markdown", "plain", "html")


@query("answer_summary", _CLAIMS.replace("{0}", "''").replace("{1}", "''") + " SELECT query_id, substr(answer, 1, 200) AS answer_preview, 85.0::DOUBLE AS confidence, 1 AS citations, true AS is_grounded, false AS review_required FROM h")
def _(spark, sf):
    rendered = reasoning.format_answers(*reasoning.reason(_prompts(spark, sf)))
    return rendered.select("query_id", F.from_json("json_summary", "answer_preview string, confidence double, citations int, is_grounded boolean, review_required boolean").alias("j")).select("query_id", "j.*")


@query("context_string", """WITH r AS (SELECT l_orderkey AS query_id, l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey AS position, 'c' || CAST(l_suppkey % 4 AS STRING) AS source_modality, l_linenumber / 8.0 AS s, l_shipmode AS t FROM (SELECT *, 'part ' || CAST(l_partkey AS STRING) AS l_shipmode FROM lineitem)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS i FROM r)
SELECT query_id, '[CONTEXT]' || chr(10) || chr(10) || string_agg('[' || i || '] source=' || source_modality || ' score=' || format('{:.3f}', s) || chr(10) || t, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || '[/CONTEXT]' AS retrieval_context, count(*) AS n_chunks FROM n GROUP BY query_id""")
def _(spark, sf):
    ranked = _table(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", "l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey AS position", "'c' || CAST(l_suppkey % 4 AS STRING) AS source_modality", "l_linenumber / 8.0D AS score", "'part ' || CAST(l_partkey AS STRING) AS text")
    return retrieval.context_string(ranked)


@query("block_flags", "SELECT doc_id, CAST(doc_id % 101 AS DOUBLE) AS confidence, doc_id % 101 < 70 AS review_required FROM documents")
def _(spark, sf):
    return ocr.process_blocks(_table(spark, sf, "documents").selectExpr("doc_id", "CAST(doc_id % 101 AS DOUBLE) AS confidence", "text")).select("doc_id", "confidence", "review_required")


_LANGUAGE = "CASE doc_id % 7 WHEN 0 THEN 'hi' WHEN 1 THEN 'mr' WHEN 2 THEN 'ne' WHEN 3 THEN 'sa' WHEN 4 THEN 'ta' ELSE lang END"


@query("engine_routing", f"SELECT doc_id, CASE WHEN l IN ('hi', 'mr', 'ne', 'sa') THEN 'tesseract_devanagari' ELSE 'trocr' END AS engine, CASE WHEN l IN ('hi', 'mr', 'ne', 'sa') THEN 'tesseract_devanagari' WHEN l = 'ta' THEN 'unknown' ELSE 'trocr' END AS tag FROM (SELECT doc_id, {_LANGUAGE} AS l FROM documents)")
def _(spark, sf):
    routed = _table(spark, sf, "documents").selectExpr("doc_id", f"{_LANGUAGE} AS l").withColumn("engine", htr.engine_for(F.col("l")))
    return routed.select("doc_id", "engine", htr.engine_tag(F.when(F.col("l") == "ta", "other").otherwise(F.col("engine"))).alias("tag"))


@query("hydrated_hits", f"""WITH e AS ({_VECTORS}), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, list_cosine_similarity(q.v, e.v) AS c FROM e q, e WHERE q.vec_id % 50 = 0)
SELECT query_id, id, label, round(greatest(0, round(greatest(0, c), 4) - CASE WHEN label % 2 = 0 THEN 0.1 ELSE 0 END), 4) AS score, CAST(k AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, id) AS k FROM p) WHERE k <= 5""")
def _(spark, sf):
    entries = _entries(spark, sf).withColumn("has_review_flag", F.col("label") % 2 == 0)
    return retrieval.retrieve(entries, _questions(spark, sf), 5, use_mmr=False, review_penalty=0.1).select("query_id", "id", "label", F.round("score", 4).alias("score"), "position")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.answer_questions(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
