"""File scans: upload guards, binary files, JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp")
DOCUMENT_EXTENSIONS = (".pdf", *IMAGE_EXTENSIONS)
AUDIO_EXTENSIONS = (".wav", ".mp3", ".m4a", ".flac", ".ogg", ".aac", ".wma", ".webm")
MAX_DOCUMENT_BYTES, MAX_AUDIO_BYTES = 50 << 20, 100 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...], max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Files under `path` that may be read, and the rejected ones with a reason (`413`, `415`).

    The tests look at path and length alone, so a rejected file's content is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    reason = F.when(F.col("length") > max_bytes, F.lit("413: too large")).when(~extension(F.col("path")).isin(*extensions), F.lit("415: type not supported"))
    marked = files.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("path", "length", "reason")


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return scan(spark, path, DOCUMENT_EXTENSIONS, MAX_DOCUMENT_BYTES)


def audio(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return scan(spark, path, AUDIO_EXTENSIONS, MAX_AUDIO_BYTES)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (height, width, nChannels, BGR data) of the formats that the JVM reads."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")


def read_records(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """JSON records of a declared schema, and the lines that do not parse."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", f"{ddl}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.where("r IS NOT NULL AND r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")
    return good, parsed.where("r IS NULL OR r._corrupt_record IS NOT NULL").select("value")


def to_json_lines(frame: DataFrame) -> DataFrame:
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("value"))


#: Tables of up to this many bytes may be dealt to all cores; larger ones are read as they are split.
DEALT_BYTES = 64 << 20


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table.  A small one with fewer splits than cores, such as one of a single row group, is dealt evenly to all of them.

    The size is the one that the scan knows; no files are listed and no larger table is ever shuffled here.
    """
    frame = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    plan = frame._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > DEALT_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores)
