"""Near-duplicate documents: MinHash with tensored banding, links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import blocks as B
from folioforge.llm.components import connected_components
from folioforge.llm.staging import bound_batches, cut
from folioforge.sources.files import table

_U = np.uint64


@dataclass(frozen=True)
class Tensoring:
    """Shape of the hash tables.

    Each of `tensors` tensors has two collections of `half_keys` half keys of `rows` minhashes; every
    pair of half keys, one from each collection, makes a table.  tensors * half_keys ** 2 tables so
    cost only 2 * tensors * half_keys * rows minhashes: 54 tables of six rows for 108 minhashes, where
    plain banding computes 324.  A pair of similarity s meets in some table with probability
    1 - (1 - (1 - (1 - s ** rows) ** half_keys) ** 2) ** tensors: 0.999998 at 0.85.
    """

    tensors: int = 6
    half_keys: int = 3
    rows: int = 3
    shingle: int = 5
    percent: int = 85

    @property
    def minhashes(self) -> int:
        return 2 * self.tensors * self.half_keys * self.rows

    @property
    def tables(self) -> int:
        return self.tensors * self.half_keys**2


def shingle_sets(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the block's rows, one after the other, and their bounds.

    A row of fewer words than `size` has one shingle, its whole sequence; without words it has none.
    """
    words = B.split_words(block, B.SPACED, B.LOWER)
    n = len(words.starts)
    counts = np.diff(words.bounds)
    gram = B.grams(words.hashes, size)
    sets: list[np.ndarray] = []
    for low, count in zip(words.bounds[:-1].tolist(), counts.tolist(), strict=True):
        if count >= size:
            own = gram[low : low + count - size + 1].copy()
            own.sort()
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            sets.append(own[fresh])
        elif count:
            sets.append(B.grams(words.hashes[low : low + count], count))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return (np.concatenate(sets) if n else np.zeros(0, np.uint64)), bounds


def _table_keys(values: np.ndarray, bounds: np.ndarray, shape: Tensoring) -> np.ndarray:
    """Keys of every table for rows with at least one shingle; shape (rows, tables)."""
    rng = np.random.default_rng(1311)
    masks = rng.integers(0, 2**64 - 1, shape.minhashes, dtype=np.uint64)
    factors = rng.integers(0, 2**63, shape.minhashes, dtype=np.uint64) * _U(2) + _U(1)
    mins = np.empty((shape.minhashes, len(bounds) - 1), np.uint64)
    scratch = np.empty_like(values)
    for k in range(shape.minhashes):
        np.bitwise_xor(values, masks[k], out=scratch)
        np.multiply(scratch, factors[k], out=scratch)
        mins[k] = np.minimum.reduceat(scratch, bounds[:-1])
    mins = mins.reshape(shape.tensors, 2, shape.half_keys, shape.rows, -1)
    halves = np.zeros(mins.shape[:3] + mins.shape[4:], np.uint64)
    for r in range(shape.rows):
        halves = B.mix(halves + mins[:, :, :, r])
    table = np.arange(shape.tables, dtype=np.uint64).reshape(shape.tensors, shape.half_keys, shape.half_keys, 1)
    keys = B.mix(halves[:, 0, :, None] ^ B.mix(halves[:, 1, None, :] + B.mix(table + _U(1))))
    return keys.reshape(shape.tables, -1).T


def _set_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums per set that tell sets of one size apart; zero for empty sets."""
    sums = np.zeros((2, len(bounds) - 1), np.int64)
    full = np.diff(bounds) > 0
    if full.any():
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            sums[k][full] = np.add.reduceat(B.mix(values ^ _U(salt)), bounds[:-1][full]).view(np.int64)
    return sums


def _signatures(shape: Tensoring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column("text")):
                values, bounds = shingle_sets(block, shape.shingle)
                sizes = np.diff(bounds)
                full = sizes > 0
                keys = pa.nulls(block.rows, pa.list_(pa.int64()))
                if full.any():
                    cuts = np.append(bounds[:-1][full], len(values))
                    made = np.ascontiguousarray(_table_keys(values, cuts, shape)).view(np.int64)
                    ends = np.concatenate([[0], np.cumsum(full)]) * shape.tables
                    keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made.reshape(-1)))
                own = (batch.column(c).slice(block.first, block.rows) for c in ("doc_id", "stamp"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), *map(pa.array, _set_sums(values, bounds)), keys], ["doc_id", "stamp", "n_shingles", "s1", "s2", "keys"])

    return run


def _sets(shape: Tensoring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column("text")):
                values, bounds = shingle_sets(block, shape.shingle)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds)), *map(pa.array, _set_sums(values, bounds)), lists], [*_SET, "shingles"])

    return run


_SET = ["n_shingles", "s1", "s2"]
_SET_DDL = "n_shingles long, s1 long, s2 long"


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (`high`, `low`) whose whole sets are similar enough."""
    left = sets.select(F.col("id").alias("high"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("low"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    return pairs.join(left, "high").join(right, "low").withColumn("common", common).where(f"100 * common >= {percent} * (size(s) + size(t) - common)").select("high", "low")


#: Ids of a side that may be broadcast, by their counted number; more are joined.
HELD_IDS = 1 << 20


def _apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Bucket members (`key`, `id`) with their component, in the buckets that hold more than one."""
    labelled = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    return cut(labelled.join(mixed, "key", "left_semi"))


def _fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity."""
    high = sizes.select(F.col("id").alias("high"), F.col("n_shingles").alias("n"))
    low = sizes.select(F.col("id").alias("low"), F.col("n_shingles").alias("m"))
    return pairs.distinct().join(high, "high").join(low, "low").where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select("high", "low")


def _alive(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The nodes (`id`, `part`) that may yet link to another part, with their size and live size.

    A shingle is live if two parts hold it; only live shingles can be common to a new link.
    """
    tokens = nodes.join(sets, "id").select("id", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("token")
    return tokens.join(shared, "token", "left_semi").groupBy("id", "part", "n").agg(F.count("*").alias("live")).where(f"100 * live >= {percent} * n")


def _labelled(docs: DataFrame, shape: Tensoring) -> DataFrame:
    """For each row of `docs` (`doc_id`, `text`): doc_id, stamp of the text, n_shingles, component_id."""
    bound_batches(docs.sparkSession)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("stamp"))
    signed = cut(frame.mapInArrow(_signatures(shape), f"doc_id long, stamp long, {_SET_DDL}, keys array<long>"))
    # A class is a set, whatever the ids of its rows; its number is any that no other class has.
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*_SET).agg(F.min("doc_id").alias("class_id"), F.first("keys").alias("keys"))
    classes = cut(named.withColumn("id", F.monotonically_increasing_id()))
    sizes = classes.select("id", "n_shingles")
    # The hub of a bucket is its class of the least doc_id: buckets of one group then mostly have the same one.
    bucketed = classes.select("id", "class_id", F.explode("keys").alias("key"))
    hubs = bucketed.groupBy("key").agg(F.min(F.struct("class_id", "id")).alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", F.col("hub.id").alias("hub"))
    members = cut(bucketed.select("id", "key").join(hubs, "key"))

    wanted = cut(classes.drop("keys").join(members.select("id").distinct(), "id", "left_semi"))
    if wanted.count() <= HELD_IDS:
        wanted = F.broadcast(wanted)
    texts = frame.join(wanted.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("text")
    sets = cut(texts.mapInArrow(_sets(shape), f"{_SET_DDL}, shingles array<long>").join(wanted, _SET).select("id", "shingles").dropDuplicates(["id"]))
    first = cut(_fitting(members.where("id <> hub").select(F.greatest("id", "hub").alias("high"), F.least("id", "hub").alias("low")), sizes, shape.percent))
    links = cut(_confirmed(first, sets, shape.percent))
    parts = connected_components(links)

    # A hub near to the key's hash by XOR is another one in each table, and yet a plain minimum.
    apart = _apart(members.select("key", "id"), parts)
    alive = cut(_alive(apart.select("id", "part").distinct(), sets, shape.percent))
    apart = apart.join(alive.select("id"), "id", "left_semi")
    mask = F.xxhash64("key")
    drawn = apart.groupBy("key").agg(F.min(F.struct(F.col("id").bitwiseXOR(mask).alias("x"), "part")).alias("hub")).select("key", F.col("hub.x").bitwiseXOR(mask).alias("hub"), F.col("hub.part").alias("hub_part"))
    second = apart.join(drawn, "key").where("part <> hub_part").select(F.greatest("id", "hub").alias("high"), F.least("id", "hub").alias("low"))
    second = cut(_fitting(second, sizes, shape.percent).join(first, ["high", "low"], "left_anti"))
    links = cut(links.unionByName(_confirmed(second, sets, shape.percent)))
    parts = connected_components(links)

    apart = _apart(apart.select("key", "id"), parts)
    alive = cut(_alive(apart.select("id", "part").distinct(), sets, shape.percent))
    mixed = cut(apart.select("key", "id").join(alive.select("id"), "id", "left_semi"))
    # Only the keys still mixed travel with a member: two that meet in several buckets meet in these alone.
    ready = mixed.join(alive.join(mixed.groupBy("id").agg(F.collect_set("key").alias("keys")), "id"), "id")
    a = ready.select("key", *(F.col(c).alias(f"{c}_a") for c in ("id", "part", "n", "live", "keys")))
    b = ready.select("key", *(F.col(c).alias(f"{c}_b") for c in ("id", "part", "n", "live", "keys")))
    enough = f"100 * least(live_a, live_b) >= {shape.percent} * (n_a + n_b - least(live_a, live_b))"
    once = "key = array_min(array_intersect(keys_a, keys_b))"
    pairs = a.withColumnRenamed("key", "key_a").join(b, F.expr(f"key_a = key AND id_a > id_b AND part_a <> part_b AND {enough} AND {once}"))
    third = pairs.select(F.col("id_a").alias("high"), F.col("id_b").alias("low")).join(first.unionByName(second), ["high", "low"], "left_anti")
    late = cut(_confirmed(third, sets, shape.percent))
    if not late.isEmpty():
        parts = connected_components(links.unionByName(late))

    linked = classes.select(*_SET, "class_id", "id").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("least"))
    linked = linked.join(named, "component", "left").select(*_SET, F.coalesce("least", "class_id").alias("least"))
    full = signed.drop("keys").join(linked, _SET, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("least", "doc_id"))
    return full.select("doc_id", "stamp", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, shape: Tensoring = Tensoring()) -> DataFrame:
    """For each row of `docs` (`doc_id`, `text`): doc_id, n_shingles, component_id, kept.

    A row's set is its distinct five-word shingles (A-Z lower-cased; fewer words make one shingle; no
    words, or a null text, make none, and link with nothing).  Shingles are 64-bit hashes of whole
    words.  Rows with equal sets form a class, whatever their ids, and classes are compared.  Members
    of a bucket are first held against one of it, then, where a bucket still holds several components,
    against one that the key's hash draws, so a dense group is linked in linear work.  What remains
    apart is compared pair by pair across components, once per pair, but only where the live shingles
    (those that two components hold) could suffice; texts that differ from all others drop out there.
    All links are confirmed on whole sets; components are closed over links, and component_id is the
    least doc_id of any of their rows.

    kept is true where doc_id is component_id.  Rows that repeat a doc_id are rows of their own: with
    equal sets they are copies, with other texts each keeps its own links.  A null doc_id gives
    component null, links with nothing and is kept.  Ids may be any longs.  A text of any length is
    read whole; memory follows the longest text.  An empty table gives no rows; other columns are
    dropped.
    """
    out = _labelled(docs, shape).drop("stamp")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: For a stage that removes near duplicates, a similarity of 0.80 links.  The tables are those of op7: a pair
#: of similarity 0.80 meets in one with probability 0.99989, one of 0.85 with 0.999998.
STAGE = Tensoring(percent=80)


def drop_near_duplicates(docs: DataFrame, shape: Tensoring = STAGE) -> DataFrame:
    """One document of each near-duplicate component, that of the least doc_id.

    Each row goes by the verdict of its own text, so other rows of its doc_id do not touch it; rows that
    repeat doc_id and text are one document and stay or go together.  Rows of null doc_id or without
    words stay; an empty table gives no rows; columns beyond those of documents are dropped.
    """
    gone = cut(_labelled(docs, shape).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("stamp").alias("_stamp")).distinct())
    if gone.count() <= HELD_IDS:
        gone = F.broadcast(gone)
    kept = docs.withColumn("_own", F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_stamp")), "left_anti")
    return kept.select("doc_id", "text", "lang", "source", "n_chars")


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, min(other) = r.doc_id AS kept
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
