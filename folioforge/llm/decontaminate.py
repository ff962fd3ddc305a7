"""Benchmark decontamination by winnowing: selected k-gram fingerprints, joined and extended to whole shared spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import blocks as B
from folioforge.llm.staging import bound_batches, cut
from folioforge.sources.files import table

_U = np.uint64
SPAN = 13
GRAM = 5
#: Most bytes of the filter of benchmark hashes that every worker holds, whatever the benchmark's size.  A full
#: filter lets more windows through to the join; the result is the same.
FILTER_BYTES = 16 << 20
_FILTER_BITS = 16  # a hash, while the filter is below its limit
#: Contaminated texts, by their counted number, that may be broadcast (16 bytes each); more are joined.
HELD_TEXTS = 1 << 20


def winnow(words: B.Words, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected k-grams: the last least one of every window of span words.

    Equal runs of `span` words select the same k-gram at the same place, so none is missed.
    """
    hashes = B.grams(words.hashes, gram)
    n = len(words.hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, span - gram + 1):
        near = hashes[k : k + n]
        better = near <= least
        np.copyto(least, near, where=better)
        at[better] = np.flatnonzero(better) + k
    chosen = np.zeros(len(hashes), bool)
    chosen[at[B.whole_positions(words.bounds, span, n)]] = True
    at = np.flatnonzero(chosen)
    return at, hashes[at]


def _words(texts: pa.Array) -> Iterator[tuple[B.Block, B.Words]]:
    for block in B.text_blocks(texts):
        yield block, B.split_words(block, B.ALNUM, B.LOWER)


def _codes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Codes of the windows of `size` words from the given positions on; windows of other sizes have other codes."""
    return B.mix(B.grams_at(hashes, at, size) + _U(size * 0x9FB21C651E98DF25 % 2**64))


def _item_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every item's window codes with their size, and its fingerprints with size 0."""
    for batch in batches:
        for block, words in _words(batch.column("text")):
            sizes, total = np.diff(words.bounds), len(words.hashes)
            at, prints = winnow(words)
            parts = [(np.searchsorted(words.bounds, at, "right") - 1, prints, 0)]
            for size in np.unique(np.minimum(sizes[sizes > 0], SPAN)).tolist():
                ok = np.flatnonzero(B.whole_positions(words.bounds, size, total - size + 1))
                rows = np.searchsorted(words.bounds, ok, "right") - 1
                if size < SPAN:
                    ok, rows = ok[sizes[rows] == size], rows[sizes[rows] == size]
                parts.append((rows, _codes(words.hashes, ok, size), size))
            for rows, codes, size in parts:
                item = batch.column("item").slice(block.first, block.rows).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([item, pa.array(codes.view(np.int64)), pa.array(np.full(len(codes), size, np.int32))], ["item", "code", "size"])


def _filter(codes: DataFrame, count: int, most_bytes: int) -> np.ndarray:
    """Three bits for every code in one of a power of two of 64-bit slots, at most `most_bytes`, made by Spark."""
    slots = 64
    wanted = min(count * _FILTER_BITS // 64, most_bytes // 8)
    while slots < wanted:
        slots *= 2
    bit = lambda k: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(code, {k}) & 63 AS INT))")
    slot = F.shiftrightunsigned("code", 64 - (slots.bit_length() - 1))
    made = codes.groupBy(slot.alias("slot")).agg(F.bit_or(bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))).alias("bits")).toArrow()
    out = np.zeros(slots, np.int64)
    out[made.column("slot").to_numpy()] = made.column("bits").to_numpy()
    return out.view(np.uint64)


def _passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    want = np.zeros(len(codes), np.uint64)
    for k in (0, 6, 12):
        want |= _U(1) << ((codes >> _U(k)) & _U(63))
    return bits[codes >> _U(64 - (len(bits).bit_length() - 1))] & want == want


def _candidates(held, sizes: list[int]):
    """Word count of each row, and its windows that may be an item's: code, size and places, one entry a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for block, words in _words(batch.column("text")):
                at, prints = winnow(words)
                # A shared window holds a selected k-gram at the same place in both texts: only windows around a match are looked up.
                near = at[_passes(bits, prints)]
                starts = np.unique(near[:, None] - np.arange(SPAN - GRAM + 1))
                rows, codes, lengths, places = [], [], [], []
                for size in sizes:
                    fits = B.whole_positions(words.bounds, size, len(words.hashes) - size + 1)
                    ok = starts[(starts >= 0) & (starts < len(fits))] if size == SPAN else np.arange(len(fits))
                    ok = ok[fits[ok]]
                    code = _codes(words.hashes, ok, size)
                    passed = _passes(bits, code)
                    ok, code = ok[passed], code[passed]
                    row = np.searchsorted(words.bounds, ok, "right") - 1
                    rows.append(row)
                    codes.append(code)
                    lengths.append(np.full(len(ok), size, np.int32))
                    places.append((ok - words.bounds[row]).astype(np.int32))
                row, code, length, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, codes, lengths, places))
                order = np.lexsort((place, code, row))
                row, code, length, place = row[order], code.view(np.int64)[order], length.astype(np.int32)[order], place.astype(np.int32)[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                first = np.flatnonzero(fresh)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place))
                entries = pa.StructArray.from_arrays([pa.array(code[first]), pa.array(length[first]), lists], ["code", "size", "at"])
                own = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(block.rows + 1)).astype(np.int32)), entries)
                ids = (batch.column(c).slice(block.first, block.rows) for c in ("doc_id", "s1", "s2"))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(words.bounds), pa.int64()), own], ["doc_id", "s1", "s2", "n_words", "seen"])

    return run


_SCANNED = "doc_id long, s1 long, s2 long, n_words long, seen array<struct<code:long,size:int,at:array<int>>>"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that lie in any of a text's windows."""
    for batch in batches:
        hit = []
        for n, spans in zip(batch.column("n_words").to_pylist(), batch.column("spans"), strict=True):
            cover = np.zeros(n + 1, np.int64)
            at = spans.values.field("at")
            sizes = np.repeat(spans.values.field("size").to_numpy(), at.value_lengths().to_numpy())
            at = at.flatten().to_numpy()
            np.add.at(cover, at, 1)
            np.add.at(cover, at + sizes, -1)
            hit.append(int((np.cumsum(cover[:n]) > 0).sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("s1", "s2", "n_words")), pa.array(hit, pa.int64()), batch.column("classes")], ["s1", "s2", "n_words", "n_hit", "classes"])


def _stamped(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, "text", F.xxhash64("text").alias("s1"), F.xxhash64(F.lit(7), "text").alias("s2"))


def _judged(docs: DataFrame, benchmark: DataFrame, filter_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned rows; texts with hits and the classes of windows hit; items of each class.

    A class is all windows that stand in the same items: a passage that many items share is one, so a
    text meets few classes however many items and windows it hits.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text IS NOT NULL")
    codes = cut(items.mapInArrow(_item_codes, "item string, code long, size int").distinct())
    counts = dict(codes.groupBy("size").count().collect())  # fingerprints and at most SPAN sizes
    held = spark.sparkContext.broadcast(_filter(codes, sum(counts.values()), filter_bytes))
    frame = _stamped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    scanned = cut(frame.select("doc_id", "s1", "s2", "text").mapInArrow(_candidates(held, sorted(counts.keys() - {0})), _SCANNED))

    windows = codes.where("size > 0").select("code", "item")
    shared = windows.groupBy("code").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    named = shared.groupBy("n", "x", "y").agg(F.min("code").alias("class"))
    classes = shared.join(named, ["n", "x", "y"]).select("code", "class")
    members = windows.join(named.select(F.col("class").alias("code")), "code", "left_semi").withColumnRenamed("code", "class")

    texts = scanned.where("size(seen) > 0").groupBy("s1", "s2").agg(F.first("n_words").alias("n_words"), F.first("seen").alias("seen"))
    met = texts.select("s1", "s2", "n_words", F.inline("seen")).join(classes, "code")
    spans = met.groupBy("s1", "s2", "n_words").agg(F.collect_list(F.struct("size", "at")).alias("spans"), F.array_sort(F.collect_set("class")).alias("classes"))
    return scanned, cut(spans.mapInArrow(_covered, "s1 long, s2 long, n_words long, n_hit long, classes array<long>")), members


_CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def find_contamination(docs: DataFrame, benchmark: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Words of each of `docs` (`doc_id`, `text`) that stand in a window of `benchmark` (`item_id`, `text`).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.  A window is
    13 consecutive words of an item, or all words of a shorter one.  Result per row: doc_id, n_words,
    n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated (at
    least a twentieth of the words, and one, are hit).

    Fingerprints of the documents that pass a filter of the benchmark's are extended to the windows
    around them, and those are joined with the benchmark's by 64-bit hashes; only hashes and places travel.  A text
    that many rows share is looked up once.

    A null text has no words; items with null text or without words have no window, a null item_id is
    listed as an empty string; rows of one item_id are one item; repeated rows are judged alike; an
    empty table gives no rows and an empty benchmark no hits; other columns are dropped.  A text of
    any length is read whole; memory follows the longest text.
    """
    scanned, hits, members = _judged(docs, benchmark, filter_bytes)
    sets = hits.select("classes").distinct()
    items = sets.select("classes", F.explode("classes").alias("class")).join(members, "class").groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = items.select("classes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    verdicts = hits.join(listed, "classes").select("s1", "s2", "n_hit", "n_items", "items_sha256")
    rows = scanned.select("doc_id", "s1", "s2", "n_words", (F.size("seen") > 0).alias("seen"))
    blank = rows.where("NOT seen").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    met = rows.where("seen").join(verdicts, ["s1", "s2"], "left")
    met = met.select("doc_id", "n_words", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return blank.unionByName(met).withColumn("contaminated", F.expr(_CONTAMINATED))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The documents that are not contaminated.

    Each row goes by its own text, be its doc_id null or repeated; null texts and texts without words
    stay; an empty table gives no rows and an empty benchmark drops none; columns beyond those of
    documents are dropped.  Contaminated texts are broadcast only up to `HELD_TEXTS`, counted.
    """
    _, hits, _ = _judged(docs, benchmark, filter_bytes)
    gone = cut(hits.where(_CONTAMINATED).select("s1", "s2"))
    if gone.count() <= HELD_TEXTS:
        gone = F.broadcast(gone)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return _stamped(docs, "doc_id", "lang", "source", "n_chars").join(gone, ["s1", "s2"], "left_anti").select(*columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
seen AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, seen.n, item_id FROM seen JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS all_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
