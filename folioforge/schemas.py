"""Record types as Spark types, and the rules that their values obey."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.scores import review_required
from folioforge.functions.text import is_blank

BOX = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"
WORD = "struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>"
OCR_BLOCK = f"struct<page:int,type:string,text:string,confidence:double,bbox:{BOX},review_required:boolean,ocr_engine:string>"
METADATA = "struct<doc_type:string,parties:array<string>,date:string,jurisdiction:string>"
OCR_RESULT = f"document_id string, source string, language string, pages int, full_text string, blocks array<{OCR_BLOCK}>, metadata {METADATA}, low_confidence_pages array<int>"
LAYOUT_REGION = "struct<x0:int,y0:int,x1:int,y1:int,block_type:string,confidence:double>"
HTR_REGION = f"struct<page:int,type:string,text:string,confidence:double,bbox:{BOX},review_required:boolean,htr_engine:string,language:string>"
HTR_RESULT = f"document_id string, source string, input_type string, language string, regions array<{HTR_REGION}>, full_text string, low_confidence_regions int"
HANDWRITTEN_REGION = "struct<x0:int,y0:int,x1:int,y1:int,hw_type:string,hw_score:double>"
RECOGNITION = "struct<text:string,confidence:double,language:string>"
RAW_SEGMENT = "struct<segment_id:int,start_s:double,end_s:double,text:string,avg_logprob:double,no_speech_prob:double,language:string>"
TRANSCRIPTION = f"segments array<{RAW_SEGMENT}>, language string, language_probability double, duration_s double"
ASR_SEGMENT = "struct<segment_id:int,start_s:double,end_s:double,text:string,confidence:double,no_speech_prob:double,review_required:boolean,asr_engine:string,language:string>"
ASR_RESULT = f"document_id string, source string, language string, language_probability double, duration_s double, transcript string, segments array<{ASR_SEGMENT}>, intent string, low_confidence_segments int"
REVIEW_FLAG = "struct<modality:string,text:string,reason:string>"
MODALITY_BLOCK = "struct<source:string,text:string,language:string,word_count:bigint,has_review_flags:boolean>"
FUSED_DOCUMENT = f"document_id string, source_ids array<string>, modalities array<{MODALITY_BLOCK}>, fused_text string, primary_language string, detected_intent string, review_flags array<{REVIEW_FLAG}>, total_word_count bigint"
CHUNK = "chunk_id string, document_id string, source_modality string, text string, chunk_index int, start_char int, end_char int, has_review_flag boolean, score double"
ENTRY = f"{CHUNK}, embedding array<double>, collection string, seq bigint"
QUERY = "query string, top_k int, collection string, use_mmr boolean, mmr_lambda double, min_score double"
CITATION = "struct<chunk_id:string,document_id:string,source_modality:string,text_excerpt:string,relevance_score:double>"
LEGAL_QUERY = "query string, fused_document_text string, retrieval_context string, language string, detected_intent string, max_tokens int"
ANSWER = f"answer_id string, query string, answer_text string, citations array<{CITATION}>, confidence double, language string, detected_intent string, llm_engine string, is_grounded boolean, review_required boolean"
CITATION_BLOCK = "struct<index:int,source_modality:string,text_excerpt:string,chunk_id:string,relevance_score:double>"
RESPONSE = f"response_id string, query string, answer string, citations array<{CITATION_BLOCK}>, format string, language string, confidence double, is_grounded boolean, review_required boolean"

SOURCES = ("OCR", "HTR", "ASR", "TYPED")
INTENTS = ("question", "instruction", "narration", "unknown")
FORMATS = ("markdown", "plain", "html", "json")
BLOCK_TYPES = ("heading", "body", "table", "footer", "page_number")

Rule = tuple[str, Column]


def parsed(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def between(name: str, low: float, high: float) -> Rule:
    return f"{name} outside [{low}, {high}]", F.col(name).between(low, high)



def box_rules() -> list[Rule]:
    return [("x0 outside [0, x1)", (F.col("x0") >= 0) & (F.col("x0") < F.col("x1"))), ("y0 outside [0, y1)", (F.col("y0") >= 0) & (F.col("y0") < F.col("y1"))), ("page below 1", F.col("page") >= 1)]


def segment_rules() -> list[Rule]:
    return [("segment_id below 0", F.col("segment_id") >= 0), ("ends before it starts", F.col("end_s") >= F.col("start_s")), between("no_speech_prob", 0, 1)]


def query_rules() -> list[Rule]:
    return [("empty query", ~is_blank(F.col("query"))), between("top_k", 1, 50), between("mmr_lambda", 0, 1), between("min_score", 0, 1)]


def chunk_rules() -> list[Rule]:
    return [("empty text", F.length("text") > 0), ("negative index", (F.col("chunk_index") >= 0) & (F.col("start_char") >= 0) & (F.col("end_char") >= 0)), ("score outside [0, 1]", F.col("score").isNull() | F.col("score").between(0, 1))]


def token_rules() -> list[Rule]:
    return [between("max_tokens", 64, 8192)]


def checked(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds `errors`: the names of the rules that a row breaks; a value that is missing breaks its rule."""
    found = F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules))
    return frame.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def split_rejects(frame: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """The rows that obey all rules, and the others with their errors."""
    marked = checked(frame, rules)
    return marked.where("size(errors) = 0").drop("errors"), marked.where("size(errors) > 0")


def with_review_flag(frame: DataFrame) -> DataFrame:
    """An explicit flag survives; else a low confidence sets it."""
    given = F.coalesce("review_required", F.lit(False)) if "review_required" in frame.columns else F.lit(False)
    return frame.withColumn("review_required", given | review_required(F.col("confidence")))


def one_of(column: str, values: tuple[str, ...]) -> Rule:
    return f"unknown {column}", reduce(lambda a, b: a | b, (F.col(column) == v for v in values))
