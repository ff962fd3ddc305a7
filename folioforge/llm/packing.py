"""Best-two-fit packing of token pieces into sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import blocks as B
from folioforge.llm.staging import bound_batches, cut
from folioforge.sources.files import table

SEQUENCE = 1024
END_ID = 2
#: Pieces that one task packs; a sequence never mixes shards, which costs about one sequence each.
SHARD_PIECES = 200_000
#: Ids of known chunks that a worker holds (4 bytes each), and slots that find them (24 bytes each); powers of two.
_RING_IDS = 1 << 23
_SLOTS = 1 << 21
_SLOT_SHIFT = np.uint64(43)
#: Chunks of more ids, such as texts without spaces, are encoded where they stand and not held.
_HELD_IDS = 64
#: Chunks encoded at once; the tokenizer's own records of them are far larger than their ids.
_BATCH_CHUNKS = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts, computed once for each distinct chunk that is still held.

    Chunks are held by two hashes of their bytes that share no state, 128 bits; memory is fixed.

    The byte-level pre-tokenizer lets a space only begin a token, so a text can be cut before a
    space that a visible character follows, and the chunks encoded apart.  A space before a
    non-ASCII byte is a cut only after a visible ASCII character, as that byte may begin another
    white space.  A text that holds one of the vocabulary's special strings is one chunk: these are
    found before words are, and change how spaces beside them are taken.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added)) if added else None
        # A ring of ids, and slots that say where in it a chunk's ids are: two hashes of the chunk, place << 7 | length.
        self.ring, self.top = np.zeros(_RING_IDS, np.uint32), _RING_IDS
        self.first, self.second, self.packed = (np.zeros(_SLOTS, t) for t in (np.uint64, np.uint64, np.int64))

    def _look_up(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Packed place of every chunk that the ring holds, else -1; the oldest quarter counts as gone, as a block may overwrite it."""
        out = np.full(len(first), -1, np.int64)
        for hashes in (first, second):
            slot = hashes >> _SLOT_SHIFT
            same = (self.first[slot] == first) & (self.second[slot] == second) & (self.packed[slot] >> 7 >= self.top - 3 * _RING_IDS // 4)
            out[same] = self.packed[slot[same]]
        return out

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and their numbers."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low in range(0, len(chunks), _BATCH_CHUNKS):
            made = self.tokenizer.encode_batch_fast([c.decode() for c in chunks[low : low + _BATCH_CHUNKS]], add_special_tokens=False)
            lists = [m.ids for m in made]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _hold(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Write new chunks to the ring and to slots, free ones first; their packed places."""
        packed = (self.top + np.cumsum(sizes) - sizes) << 7 | sizes
        self.ring[np.arange(self.top, self.top + len(ids)) & (_RING_IDS - 1)] = ids
        self.top += len(ids)
        slot, other = first >> _SLOT_SHIFT, second >> _SLOT_SHIFT
        taken = self.packed[slot] >> 7 >= self.top - 3 * _RING_IDS // 4
        slot, kept = np.unique(np.where(taken, other, slot), return_index=True)
        self.first[slot], self.second[slot], self.packed[slot] = first[kept], second[kept], packed[kept]
        return packed

    def _cuts(self, block: B.Block) -> np.ndarray:
        data = block.data
        visible = (data > 0x20) & (data < 0x7F)
        cut_at = np.zeros(len(data), bool)
        if len(data) > 2:
            after, before = data[2:], visible[:-2]
            cut_at[1:-1] = (data[1:-1] == 0x20) & (visible[2:] | (after >= 0x80) & before)
        starts = block.offsets[:-1][np.diff(block.offsets) > 0]
        ends = starts[starts > 0] - 1
        cut_at[ends] = False  # the space at the end of a text is followed by another text
        special = np.array([m.start() for m in self.added.finditer(data)] if self.added else [], np.int64)
        for row in np.unique(np.searchsorted(block.offsets, special, "right") - 1).tolist():
            cut_at[block.offsets[row] : block.offsets[row + 1]] = False
        cut_at[starts] = True
        return np.flatnonzero(cut_at)

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts one after the other, and their bounds."""
        starts = self._cuts(block)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(block.rows + 1, np.int64)
        ends = np.append(starts[1:], len(block.data))
        hashes = B.range_hashes(block.data, starts, ends)
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not B.same_ranges(block.data, starts, ends, at[which]):  # equal hashes of unequal chunks: go by the chunks
            chunks = [block.data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(c, len(seen)) for c in chunks])
            _, at = np.unique(which, return_index=True)
        first, second = hashes[at], B.range_hashes(block.data, starts[at], ends[at], B.OTHER_SEED)
        packed = self._look_up(first, second)
        new = np.flatnonzero(packed < 0)
        ids, sizes = self._encode_chunks([block.data[a:b].tobytes() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        held = sizes <= _HELD_IDS
        held &= np.cumsum(sizes * held) <= _RING_IDS // 4
        packed[new[held]] = self._hold(first[new[held]], second[new[held]], ids[np.repeat(held, sizes)], sizes[held])
        begin, counts = packed >> 7, packed & 127
        begin[new[~held]], counts[new[~held]] = (np.cumsum(sizes) - sizes)[~held], sizes[~held]
        lengths = counts[which]
        ends_at = np.cumsum(lengths)
        source = np.repeat(begin[which] - (ends_at - lengths), lengths) + np.arange(ends_at[-1])
        out = self.ring[source & (_RING_IDS - 1)]
        if not held.all():
            fresh = np.zeros(len(at), bool)
            fresh[new[~held]] = True
            own = np.repeat(fresh[which], lengths)
            out[own] = ids[source[own]]
        return out, np.concatenate([[0], ends_at])[np.searchsorted(starts, block.offsets)]


def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that chunks stay known from task to task, until other work runs there."""
    found = next((k for k in B.kept if isinstance(k, Encoder) and k.path == path), None) or Encoder(path)
    B.kept[:] = [found]
    return found


def _pieces(path: str | None, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or default_tokenizer())
        tail = np.array([end_id], "<u4")
        for batch in batches:
            for block in B.text_blocks(batch.column("text"), keep=True):
                ids, bounds = encoder.encode(block)
                rows, piece, start, length, crc = [], [], [], [], []
                for row in range(block.rows):
                    own = np.concatenate([ids[bounds[row] : bounds[row + 1]].astype("<u4"), tail])
                    at, k = 0, 0
                    while at < len(own):
                        end = at + ((len(own) - at) % size or size)
                        rows.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(end - at)
                        crc.append(zlib.crc32(own[at:end].tobytes()))
                        at, k = end, k + 1
                doc = batch.column("doc_id").slice(block.first, block.rows).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=_PIECES_ARROW)

    return run


def best_two_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length; equal lengths are taken in their given order.

    Sequence by sequence: take the longest piece that fits until none does; then, if a gap is left,
    exchange the shortest piece taken for the two unpacked ones whose sum comes nearest to the
    gap with that piece's room, if it is more than that piece.
    """
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=size + 1)
    nexts = (np.cumsum(counts) - counts).tolist()
    left = counts.tolist()
    open_ = sum(1 << n for n in range(1, size + 1) if left[n])
    bins: list[list[int]] = []

    def take(n: int) -> None:
        nonlocal open_
        left[n] -= 1
        if not left[n]:
            open_ &= ~(1 << n)

    while open_:
        gap, taken = size, []
        while gap and (fits := open_ & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            take(n)
            taken.append(n)
            gap -= n
        if gap and len(taken) > 1 and open_:
            room = gap + taken[-1]
            best, pair, a = taken[-1], None, room - 1
            while a and (fits := open_ & ((2 << a) - 1)):
                a = fits.bit_length() - 1
                if 2 * a <= best:
                    break
                b = min(a, room - a)
                seconds = (open_ if b < a or left[a] > 1 else open_ & ~(1 << a)) & ((2 << b) - 1)
                if seconds and a + (b := seconds.bit_length() - 1) > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a -= 1
            if pair:
                n = taken.pop()
                if not left[n]:
                    open_ |= 1 << n
                left[n] += 1
                for n in pair:
                    take(n)
                    taken.append(n)
        bins.append(taken)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, taken in enumerate(bins):
        at = 0
        for n in taken:
            row = order[nexts[n]]
            nexts[n] += 1
            sequence[row], offset[row] = k, at
            at += n
    return sequence, offset


def _pack_shard(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        sequence, offset = best_two_fit(frame["length"].to_numpy(np.int64), size)
        return frame.drop(columns="shard").assign(sequence_id=frame["shard"].to_numpy(np.int64) * (1 << 40) + sequence, offset=offset)

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack the token ids of `docs` (`doc_id`, `text`) into sequences of at most `size`.

    A document is its ids and `end_id`; only longer ones are cut, and their first piece takes the
    remainder.  Result per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Pieces are dealt by hash to shards of about `shard_pieces` whatever the table's size, and each
    shard is packed by itself, so no task grows with the data and no key can be hot.

    A null text is empty: one piece of one id.  A null doc_id stays null; repeated rows are packed
    each; an empty table gives no rows; other columns are dropped.  Special strings of the vocabulary
    become their ids, as the tokenizer's plain call has it.  A text of any length is encoded whole;
    memory follows the longest text.  `tokenizer` None means the public byte-level vocabulary as
    installed on each worker.
    """
    bound_batches(docs.sparkSession)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(frame.mapInArrow(_pieces(tokenizer, size, end_id), _PIECES))
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(_pack_shard(size), f"{_PIECES}, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, f"{sf_dir}/documents.parquet"))
