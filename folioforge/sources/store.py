"""The vector table: chunks with embeddings, partitioned by collection."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows without those whose (collection, chunk_id) is delivered anew, and the fresh ones, at the end."""
    kept = stored.join(fresh.select("collection", "chunk_id").distinct(), ["collection", "chunk_id"], "left_anti")
    return kept.unionByName(fresh)


class VectorTable:
    """Chunks at a path, a folder for each collection.

    Each upsert writes a new version of its own collection beside the old one, so a failed write leaves the
    table whole and other collections are not touched; versions before the last two are deleted.  Writers
    of one collection must take turns: a second one finds the version's folder and fails.

    `seq` keeps the order of insertion, by which equal scores are settled: by batch, then in the order of
    document, chunk and id; replaced rows move to the end.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _listed(self, path: str) -> list[str]:
        root = self.jvm.Path(path)
        self.files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in self.files.listStatus(root)] if self.files.exists(root) else []

    def _folder(self, collection: str) -> str:
        return f"{self.path}/c-{quote(collection, safe='')}"

    def _versions(self, folder: str) -> list[int]:
        names = [n for n in self._listed(folder) if n.startswith("v")]
        return sorted(int(n[1:]) for n in names if self.files.exists(self.jvm.Path(f"{folder}/{n}/_SUCCESS")))

    def read(self, collection: str | None = None) -> DataFrame | None:
        """The rows of a collection or of all; None where nothing was ever stored."""
        folders = [f"{self.path}/{n}" for n in self._listed(self.path) if n.startswith("c-")] if collection is None else [self._folder(collection)]
        newest_ones = [f"{f}/v{v[-1]}" for f in folders if (v := self._versions(f))]
        return self.spark.read.parquet(*newest_ones) if newest_ones else None

    def _replace(self, collection: str, rows: DataFrame) -> None:
        folder = self._folder(collection)
        versions = self._versions(folder)
        rows.write.parquet(f"{folder}/v{(versions or [0])[-1] + 1}")
        for old in versions[:-1]:
            self.files.delete(self.jvm.Path(f"{folder}/v{old}"), True)

    def upsert(self, chunks: DataFrame, collection: str = "legal_ai_default") -> None:
        """Add `chunks` (`chunk_id`, `embedding`, ...) to a collection; of rows that share a chunk_id the last by their other columns stays."""
        stored = self.read(collection)
        top = 0 if stored is None else stored.agg(F.max("seq")).first()[0] or 0
        plain = [c for c in ("document_id", "chunk_index", "text") if c in chunks.columns]
        last = Window.partitionBy("chunk_id").orderBy(*(F.desc(c) for c, kind in chunks.dtypes if "map<" not in kind))
        once = chunks.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k").orderBy(*plain, "chunk_id")
        fresh = once.withColumn("collection", F.lit(collection)).withColumn("seq", F.monotonically_increasing_id() + top + 1)
        self._replace(collection, fresh if stored is None else upserted(stored, fresh))

    def get(self, ids: DataFrame, collection: str = "legal_ai_default") -> DataFrame:
        """Chunks by id; unknown ids give no row."""
        return self.read(collection).join(ids, "chunk_id", "left_semi")

    def delete_collection(self, collection: str = "legal_ai_default") -> None:
        stored = self.read(collection)
        if stored is not None:
            self._replace(collection, stored.limit(0))

    def count(self, collection: str = "legal_ai_default") -> int:
        stored = self.read(collection)
        return 0 if stored is None else stored.count()


def newest(rows: DataFrame) -> DataFrame:
    """The last row of each chunk of a collection, for tables that were appended to."""
    last = Window.partitionBy("collection", "chunk_id").orderBy(F.desc("seq"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
