"""Files to recognised documents: pages, handwriting and speech, each a chain of scan, model and native steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import scores, text
from folioforge.operators import asr, htr, ocr
from folioforge.plans import engines
from folioforge.sources import files, media


def pdf_pages(documents: DataFrame, engine: str = "pymupdf") -> DataFrame:
    """Pages of PDF files (`path`, `content`): path, page, native_text, raster."""
    made = documents.where(files.extension(F.col("path")) == ".pdf").select("path", engines.run("pdf", engine, F.col("content")).alias("pages"))
    return made.select("path", F.explode("pages").alias("p")).select("path", "p.page", "p.native_text", "p.raster")


def read_documents(documents: DataFrame, pdf: str = "pymupdf", recognise: str = "paddle", decode: Callable[[bytes], np.ndarray] = media.decode_image, layout: str | None = None) -> DataFrame:
    """One OCR result per file.

    A page with enough text of its own is not recognised; the two kinds of page part before the model,
    as a UDF is not short-circuited, and meet again as blocks.  A scanned page is cut into its layout
    regions, each classified by its place and recognised by itself, in reading order; what does not
    decode goes to the engine whole.  `layout` names a registered layout engine; without one ink is searched.
    """
    pages = pdf_pages(documents, pdf)
    image = documents.where(files.extension(F.col("path")) != ".pdf").select("path", F.lit(1).alias("page"), F.lit("").alias("native_text"), F.col("content").alias("raster"))
    native, scanned = ocr.split_native(pages.unionByName(image))
    paragraphs = native.select("path", "page", F.posexplode(F.split("native_text", r"\n\s*\n")).alias("pos", "text"))
    placed = paragraphs.withColumn("y0", F.col("pos") / F.count("*").over(_page())).withColumn("page_height", F.lit(1.0))
    first = ocr.native_blocks(placed).select("path", "page", "pos", "type", "text", "confidence", "ocr_engine")
    if layout:
        scanned = scanned.withColumn("regions", engines.run("layout", layout, F.col("raster")))
    regions = media.layout_crops(scanned, decode)
    kind = F.when(F.col("width").isNull(), "body").when(F.col("block_type").isNotNull(), F.col("block_type")).otherwise(scores.layout_class(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height"))))
    region = F.struct(*(F.coalesce(c, F.lit(0)).alias(n) for n, c in zip(("band", "x0", "y0"), (*scores.reading_order(F.col("y0"), F.col("x0")), F.col("y0")), strict=True)), kind.alias("type"))
    told = regions.select("path", "page", region.alias("region"), engines.run("ocr", recognise, F.col("crop")).alias("words"))
    words = told.select("path", "page", "region", F.posexplode("words").alias("pos", "w")).select("path", "page", "region", "pos", "w.*")
    keys = ["path", "page", "region"]
    lines = ocr.words_to_text(words, keys).join(words.groupBy(*keys).agg(scores.mean_confidence_agg(F.col("confidence")).alias("confidence")), keys)
    numbered = lines.withColumn("pos", F.row_number().over(_page().orderBy("region")) - 1)
    second = numbered.select("path", "page", "pos", "region.type", "text", "confidence", F.lit(recognise).alias("ocr_engine"))
    return ocr.assemble(first.unionByName(second).withColumnRenamed("path", "document_id"))


def _page():
    return Window.partitionBy("path", "page")


def handwriting_regions(images: DataFrame, least_area: int = 400, least_score: float = 0.25, pad: int = 4, overlap: float = 0.3) -> DataFrame:
    """Scored and classified handwriting of decoded pages (`origin`, `height`, `width`, `nChannels`, `data`), overlaps suppressed, in reading order.

    Pixels give boxes and features; score, class, suppression and order are native.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (h, w, c, data) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("height", "width", "nChannels", "data")), strict=True)):
                raw = np.frombuffer(data, np.uint8)
                gray = media.to_gray(raw.reshape(h, w, c) if c > 1 else raw.reshape(h, w))
                for x0, y0, x1, y1, _ in media.components(media._closed(media.edges(gray), 15, 5)):
                    if (x1 - x0) * (y1 - y0) >= least_area:
                        box = (max(0, x0 - pad), max(0, y0 - pad), min(w, x1 + pad), min(h, y1 + pad))
                        rows.append(k)
                        found.append((*box, *media.handwriting_features(gray[box[1] : box[3], box[0] : box[2]])))
            columns = list(zip(*found, strict=True)) or [()] * 7
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in ("origin", "height", "width")), *(pa.array(list(map(float, c)), pa.float64()) for c in columns)], ["origin", "height", "width", "x0", "y0", "x1", "y1", "strokes", "density", "intensity"])

    boxes = images.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "origin string, height int, width int, x0 double, y0 double, x1 double, y1 double, strokes double, density double, intensity double")
    scored = boxes.withColumn("score", scores.handwriting_score(F.col("strokes"), F.col("density"), F.col("intensity"))).where(F.col("score") >= least_score)
    one = F.struct("x0", "y0", "x1", "y1", "score", "width", "height")
    kept = scored.groupBy("origin").agg(F.array_sort(F.collect_list(one)).alias("r")).select("origin", F.explode_outer(htr.suppress_overlaps(F.col("r"), overlap)).alias("k")).where("k IS NOT NULL").select("origin", "k.*")
    kind = scores.handwriting_class(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")))
    return kept.withColumn("hw_type", kind).orderBy("origin", *scores.reading_order(F.col("y0"), F.col("x0"), 60))


def read_handwritten_pages(images: DataFrame, language: str = "en", engine: str | None = None, segment: str | None = None, **limits: float) -> DataFrame:
    """One HTR result per decoded page (`origin`, `height`, `width`, `nChannels`, `data`): regions found, cut out, read in order and joined.

    `segment` names a registered layout engine; without one `handwriting_regions` finds them within `limits`.
    """
    if segment:
        whole = media.crop_boxes(images, images.select("origin", *(F.lit(0).alias(c) for c in ("x0", "y0")), F.col("width").alias("x1"), F.col("height").alias("y1")))
        pages = whole.select(F.col("origin").alias("path"), F.lit(1).alias("page"), F.col("crop").alias("raster"))
        cut = media.layout_crops(pages.withColumn("regions", engines.run("layout", segment, F.col("raster"))))
        found = cut.select(F.col("path").alias("origin"), "x0", "y0", F.col("block_type").alias("hw_type"), "crop")
    else:
        found = media.crop_boxes(images, handwriting_regions(images, **limits))
    order = Window.partitionBy("origin").orderBy(*scores.reading_order(F.col("y0"), F.col("x0"), 60), "y0")
    placed = found.withColumn("pos", F.row_number().over(order))
    return read_handwriting(placed.select(F.col("origin").alias("document_id"), "pos", F.col("hw_type").alias("type"), "crop", F.lit(language).alias("language")), engine)


def read_handwriting(regions: DataFrame, engine: str | None = None) -> DataFrame:
    """One HTR result per document from region crops (`document_id`, `pos`, `type`, `crop`, `language`).

    Crops go to the engine of their language; an empty text stays, with confidence 0 and flagged.
    """
    routed = regions.withColumn("htr_engine", htr.engine_for(F.col("language"), engine))
    parts = [routed.where(F.col("htr_engine") == name).withColumn("r", engines.run("htr", name, F.col("crop"))) for name in ((engine,) if engine else htr.ENGINES[:2])]
    read = parts[0]
    for part in parts[1:]:
        read = read.unionByName(part)
    told = read.select("document_id", "pos", "type", F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"), htr.engine_tag(F.col("htr_engine")).alias("htr_engine"))
    return htr.assemble_text(htr.process_regions(told))


def read_speech(audio: DataFrame, engine: str = "whisper") -> DataFrame:
    """One ASR result per sound file (`path`, `content`)."""
    loaded = media.load_audio(audio).where("error IS NULL")
    segments = loaded.select(F.col("path").alias("document_id"), F.explode(engines.run("asr", engine, F.col("samples"))).alias("s")).select("document_id", "s.*")
    return asr.assemble_transcript(asr.process_segments(segments, engine)).join(loaded.select(F.col("path").alias("document_id"), "duration_s"), "document_id")


def detect_language(frame: DataFrame, engine: str = "langdetect") -> DataFrame:
    return frame.withColumn("language", F.when(text.is_blank(F.col("text")), "en").otherwise(engines.run("language", engine, F.col("text"))))
