"""Line dedup: overlapping three-line windows, repeated anywhere in the corpus, lose their later occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import blocks as B
from folioforge.llm.staging import bound_batches
from folioforge.sources.files import table

WINDOW = 3
LONG_WORDS = 50

_WINDOWS = "a long, b long, doc_id long, stamp long, pos int, last int"
_WINDOWS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("stamp", pa.int64()), ("pos", pa.int32()), ("last", pa.int32())])


def _line_bounds(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the block's lines, and where each row's lines begin."""
    breaks = np.flatnonzero(block.data == 10)
    rows = np.searchsorted(breaks, block.offsets)
    starts = np.insert(breaks + 1, rows[:-1], block.offsets[:-1])
    ends = np.insert(breaks, rows[1:], block.offsets[1:])
    return starts, ends, rows + np.arange(block.rows + 1)


def _windows(window: int, long_words: int, beside_long: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, stamps = batch.column("doc_id"), batch.column("stamp")
            for block in B.text_blocks(batch.column("text")):
                starts, ends, bounds = _line_bounds(block)
                word_starts = B.split_words(block, B.SPACED).starts
                words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
                solid = np.flatnonzero(words)
                words, row = words[solid], np.repeat(np.arange(block.rows), np.diff(bounds))[solid]
                pos, heads = solid - bounds[row], np.searchsorted(row, np.arange(block.rows + 1))
                hashes = [B.range_hashes(block.data, starts[solid], ends[solid], v) for v in (B.SEED, B.OTHER_SEED)]
                for span in range(1, window + 1):
                    at = np.flatnonzero(B.whole_positions(heads, span, len(solid) - span + 1))
                    if span < window:  # a shorter run stands by itself if it is long and, but for beside_long, no part of it is
                        long = sum(words[at + k] for k in range(span)) >= long_words
                        if span > 1 and not beside_long:
                            for k in range(span):
                                long &= words[at + k] < long_words
                        at = at[long]
                    if not len(at):
                        continue
                    pick = pa.array(row[at] + block.first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(B.grams(h, span)[at].view(np.int64)) for h in hashes), ids.take(pick), stamps.take(pick),
                            pa.array(pos[at].astype(np.int32)), pa.array(pos[at + span - 1].astype(np.int32)),
                        ],
                        schema=_WINDOWS_ARROW,
                    )

    return run


def _remove(extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, removed = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if spans:
                    gone = np.zeros(len(lines) + 1, np.int64)
                    for code in spans:
                        pos, last = divmod(code, 1 << 32)
                        gone[pos] += 1
                        gone[last + 1] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    removed.append(int(gone.sum()))
                    text = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
                else:
                    removed.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), *(batch.column(c) for c in extra)],
                ["doc_id", "n_lines", "n_removed", "text", *extra],
            )

    return run


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, carry: tuple[str, ...] = (), beside_long: bool = False) -> DataFrame:
    """Remove later occurrences of repeated line windows from `docs` (`doc_id`, `text`).

    A window is `window` consecutive lines, blank ones between them left aside: were they counted, one
    short line between two blank ones would be a window.  A shorter run also counts as one if it holds
    `long_words` words, so that a long passage on one line is found among any neighbours.  Of a run of
    two, each line must itself be shorter than that, as op9's SQL has it, so the short line of a repeated
    passage of a short and a long one stays; with `beside_long` that run counts too.
    Windows are compared by two 64-bit hashes of their bytes that share no state.  Of equal windows the first stays, in the order
    of doc_id (null first), text stamp and line; the lines that any other occurrence covers go.

    Result: doc_id, n_lines, n_removed, text without those lines, and the columns in `carry`.  A null
    text has one empty line and stays null; rows that repeat doc_id and text are one document and are
    treated alike, rows of one doc_id with other texts are other documents; an empty table gives no
    rows.  A text of any length is read in one piece: memory follows the longest text.  The windows are pre-aggregated before their shuffle,
    and hot windows meet their first occurrence in a join that Spark can split.
    """
    bound_batches(docs.sparkSession)
    extra = [f"_carry_{c}" for c in carry]
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("stamp"), *(F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)))
    found = frame.select("doc_id", "stamp", "text").mapInArrow(_windows(window, long_words, beside_long), _WINDOWS)
    order = F.struct("doc_id", "stamp", "pos")
    repeated = found.groupBy("a", "b").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("a", "b", "first")
    later = found.join(repeated, ["a", "b"]).where(F.struct("doc_id", "stamp", "pos") != F.col("first"))
    spans = later.groupBy("doc_id", "stamp").agg(F.collect_set(F.shiftleft(F.col("pos").cast("long"), 32) + F.col("last")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "stamp": "_stamp"})
    joined = frame.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("stamp") == F.col("_stamp")), "left")
    kinds = "".join(f", `{e}` {frame.schema[e].dataType.simpleString()}" for e in extra)
    out = joined.select("doc_id", "text", "spans", *extra).mapInArrow(_remove(extra), f"doc_id long, n_lines long, n_removed long, text string{kinds}")
    return out.withColumnsRenamed(dict(zip(extra, carry, strict=True)))


def strip_repeats(docs: DataFrame) -> DataFrame:
    """Documents with repeated windows removed, a short line beside a long one included; those that lose their whole text go.

    Null texts and blank ones that lost nothing stay; repeated rows and null ids are as in `dedup_lines`; an
    empty table gives no rows; columns beyond doc_id, text, lang, source and n_chars are dropped.
    """
    out = dedup_lines(docs, carry=("lang", "source"), beside_long=True).where("n_removed = 0 OR rlike(text, '[^\\\\x20\\\\x09-\\\\x0D]')")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Null texts come out empty here, as they do in the SQL."""
    return dedup_lines(table(spark, f"{sf_dir}/documents.parquet")).withColumn("text", F.coalesce("text", F.lit("")))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
runs AS (
  SELECT doc_id, pos, line, n, lead(line) OVER d AS line2, lead(n) OVER d AS n2, lead(pos) OVER d AS pos2, lead(line, 2) OVER d AS line3, lead(pos, 2) OVER d AS pos3
  FROM counted WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
windows AS (
  SELECT doc_id, pos, pos3 AS last, line || chr(10) || line2 || chr(10) || line3 AS body FROM runs WHERE line3 IS NOT NULL
  UNION ALL SELECT doc_id, pos, pos2, line || chr(10) || line2 FROM runs WHERE line2 IS NOT NULL AND n + n2 >= 50 AND n < 50 AND n2 < 50
  UNION ALL SELECT doc_id, pos, pos, line FROM runs WHERE n >= 50),
later AS (SELECT doc_id, pos, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM later)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
