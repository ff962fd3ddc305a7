"""Jobs for spark-submit: `python -m folioforge JOB ...`; tables are Parquet paths, `ocr`, `htr` and `asr` take folders of files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import fusion, reasoning
from folioforge.plans import adapters, engines, pipelines, recognition
from folioforge.sources import files

JOBS = {
    "ocr": "PDF and image files to OCR results", "htr": "image files to handwriting results", "asr": "sound files to transcripts", "fuse": "modality blocks to fused documents",
    "ingest": "fused documents to embedded chunks", "ask": "questions to answers", "reason": "questions with their context to answers", "format": "answers of `reason` in one format",
}


def _page_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def run(spark: SparkSession, job: str, given: argparse.Namespace) -> DataFrame:
    """The result of a job; `engine` and `embedder` name registered engines."""
    if job == "ocr":
        return recognition.read_documents(files.documents(spark, given.input)[0].select("path", "content"), recognise=given.engine or "paddle", layout=given.layout)
    if job == "htr":
        return recognition.read_handwritten_pages(_page_images(spark, given.input), given.language, given.engine, given.layout)
    if job == "asr":
        return recognition.read_speech(files.audio(spark, given.input)[0].select("path", "content"), given.engine or "whisper")
    rows = spark.read.parquet(given.input)
    if job == "fuse":
        return fusion.fuse(rows)
    if job == "ingest":
        return pipelines.ingest(rows, embedder=given.embedder)
    if job == "ask":
        return pipelines.ask(spark.read.parquet(given.chunks), rows, given.top_k, engine=given.engine, embedder=given.embedder)
    answers, citations = reasoning.reason(rows, engine=given.engine)
    rendered = reasoning.format_answers(answers, citations)
    return rendered if job == "reason" else rendered.select("query_id", F.col("json_summary" if given.format == "json" else given.format).alias("response"))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioforge", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("health", help="registered engines")
    for name, about in JOBS.items():
        job = jobs.add_parser(name, help=about)
        job.add_argument("--input", required=True)
        job.add_argument("--output", required=True)
        job.add_argument("--engine")
        job.add_argument("--embedder")
        job.add_argument("--layout")
        job.add_argument("--language", default="en")
        job.add_argument("--format", choices=("markdown", "plain", "html", "json"), default="markdown")
        job.add_argument("--chunks", required=name == "ask")
        job.add_argument("--top-k", type=int, default=5)
    given = parser.parse_args(arguments)
    adapters.register_all()
    if given.job == "health":
        print(json.dumps(engines.health()))
        return
    spark = SparkSession.builder.appName(f"folioforge {given.job}").getOrCreate()
    run(spark, given.job, given).write.mode("errorifexists").parquet(given.output)


if __name__ == "__main__":
    main()
