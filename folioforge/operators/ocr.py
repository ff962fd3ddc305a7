"""Print recognition: words to lines, blocks to pages, pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import scores, text

# Fixed values.
PADDLE_LANGUAGES = {"en": "en", "hi": "hi", "mr": "hi", "bn": "ta", "te": "te", "ta": "ta", "gu": "gu", "pa": "en", "zh": "ch"}
TESSERACT_LANGUAGES = {"en": "eng", "hi": "hin", "mr": "mar", "bn": "ben", "te": "tel", "ta": "tam", "gu": "guj", "pa": "pan"}
LINE_GAP = 8
NATIVE_TEXT_CHARS = 50
NATIVE_CONFIDENCE = 99.0


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def paddle_language(iso: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(PADDLE_LANGUAGES), iso), F.lit("en"))


def tesseract_language(iso: Column) -> Column:
    """`en+hi` to `eng+hin`; unknown codes to `eng`."""
    known = _lookup(TESSERACT_LANGUAGES)
    return F.array_join(F.transform(F.split(iso, r"\+"), lambda x: F.coalesce(F.try_element_at(known, F.trim(x)), F.lit("eng"))), "+")


def parse_paddle(results: Column) -> Column:
    """Words of array<struct<corners:array<array<double>>,text,confidence>>: boxes around the corners, percent, blanks dropped."""
    axis = lambda r, k: F.transform(r["corners"], lambda c: F.element_at(c, k))
    word = lambda r: F.struct(
        r["text"].alias("text"), (r["confidence"] * 100).alias("confidence"), F.array_min(axis(r, 1)).alias("x0"),
        F.array_min(axis(r, 2)).alias("y0"), F.array_max(axis(r, 1)).alias("x1"), F.array_max(axis(r, 2)).alias("y1"),
    )
    return F.transform(F.filter(results, lambda r: ~text.is_blank(r["text"])), word)


def parse_tesseract(data: Column) -> Column:
    """Words of a struct of parallel arrays (text, conf, left, top, width, height); negative confidence and blanks dropped."""
    rows = F.arrays_zip(*(data[c].alias(c) for c in ("text", "conf", "left", "top", "width", "height")))
    good = F.filter(rows, lambda r: (r["conf"] >= 0) & ~text.is_blank(r["text"]))
    box = lambda r: F.struct(r["text"].alias("text"), r["conf"].alias("confidence"), r["left"].alias("x0"), r["top"].alias("y0"), (r["left"] + r["width"]).alias("x1"), (r["top"] + r["height"]).alias("y1"))
    return F.transform(good, box)


def words_to_text(words: DataFrame, keys: list[str], order: str = "pos", gap: float = LINE_GAP) -> DataFrame:
    """Lines of words per `keys`: a new line where a word's top is more than `gap` below the bottom of the one before."""
    seq = Window.partitionBy(*keys).orderBy(order)
    broken = words.withColumn("_break", F.when(F.col("y0") - F.lag("y1").over(seq) > gap, 1).otherwise(0))
    lined = broken.withColumn("_line", F.sum("_break").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lined.groupBy(*keys, "_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda w: w["text"]), " ").alias("_text"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_text"))), lambda w: w["_text"]), "\n").alias("text"))


def split_native(pages: DataFrame, least: int = NATIVE_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pages whose own text is long enough, and those to be recognised; two branches, as a UDF is not short-circuited."""
    has = F.length(text.strip(F.coalesce("native_text", F.lit("")))) >= least
    return pages.where(has), pages.where(~has)


def native_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of a text layer (`document_id`, `page`, `pos`, `text`, `y0`, `page_height`) with class and fixed confidence."""
    return blocks.where(~text.is_blank(F.col("text"))).withColumns({"type": scores.native_block_class(F.col("text"), F.col("y0"), F.col("page_height")), "confidence": F.lit(NATIVE_CONFIDENCE), "ocr_engine": F.lit("pymupdf_text")})


def process_blocks(blocks: DataFrame) -> DataFrame:
    """Normalised text and the review flag, which is set from the confidence alone."""
    return blocks.withColumns({"text": text.normalise_ocr(F.col("text")), "review_required": scores.review_required(F.col("confidence"))})


def merge_blocks(blocks: DataFrame, key: str = "document_id", order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """Full text per document: headings stand apart; footers, page numbers and blanks are left out."""
    body = text.strip(F.col("text"))
    part = F.when(F.col("type") == "heading", F.concat(F.lit("\n\n"), body, F.lit("\n"))).otherwise(body)
    shown = F.when(~F.col("type").isin("footer", "page_number") & (body != ""), F.struct(*order, part.alias("_part")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda b: b["_part"]), "\n")
    return blocks.groupBy(key).agg(text.strip(joined).alias("full_text"))


def low_confidence_pages(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """Pages with a mean block confidence under the threshold, ascending, per document."""
    pages = blocks.groupBy(key, "page").agg(F.avg("confidence").alias("_mean"))
    return pages.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("_mean") < scores.REVIEW_BELOW, F.col("page")))).alias("low_confidence_pages"))


def regions_or_full_page(pages: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Every page's regions; a page without one gets a single `body` region of its whole size."""
    joined = pages.join(regions, keys, "left")
    return joined.select(
        *keys, F.coalesce("x0", F.lit(0)).alias("x0"), F.coalesce("y0", F.lit(0)).alias("y0"), F.coalesce("x1", "width").alias("x1"), F.coalesce("y1", "height").alias("y1"),
        F.coalesce("block_type", F.lit("body")).alias("block_type"), F.coalesce("confidence", F.lit(100.0)).alias("confidence"),
    )


def assemble(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """One result per document: processed blocks, full text, metadata, pages to review."""
    done = process_blocks(blocks)
    arrays = done.groupBy(key).agg(
        F.countDistinct("page").cast("int").alias("pages"),
        F.array_sort(F.collect_list(F.struct("page", "pos", "type", "text", "confidence", "review_required", "ocr_engine"))).alias("blocks"),
    )
    full = merge_blocks(done, key).withColumn("metadata", text.metadata(F.col("full_text")))
    return arrays.join(full, key).join(low_confidence_pages(done, key), key)


def pages_needing_review(blocks: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(blocks, lambda b: b["review_required"]), lambda b: b["page"])))


def text_blocks(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"].isin("body", "heading"))
