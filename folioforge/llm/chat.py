"""Chat formatting by prefix-target expansion: one example per assistant turn, that reply alone trainable."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_BATCH_CHARS = 8 << 20

_mark = re.compile(r"<(\\*)\|")
_escaped_mark = re.compile(r"<\\(\\*)\|")
_turn = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """`<|`, also with backslashes between, gets one more backslash, so no control string is left."""
    return _mark.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _escaped_mark.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role also stays on its line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted example."""
    return [(unescape_role(role), unescape(text)) for role, text in _turn.findall(formatted)]


_EXAMPLES = "conv_id long, example int, formatted string, loss_start long, loss_end long, is_whole boolean"
_EXAMPLES_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("is_whole", pa.bool_())])


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    prefix, pending, number, conv, seen = "", None, 0, None, False
    rows = _rows(batches, ("conv_id", "role", "text"))
    while True:
        row = next(rows, None)
        if seen and (row is None or row[0] != conv):
            # A conversation that ends without a reply leaves a last example without a trainable part.
            out.append((*pending[:-1], True) if pending else (conv, number, prefix, len(prefix), len(prefix), True))
            size += len(out[-1][2])
            prefix, pending, number = "", None, 0
        if (out and row is None) or size > _BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _EXAMPLES_ARROW, strict=True)], schema=_EXAMPLES_ARROW)
            out, size = [], 0
        if row is None:
            return
        seen, conv = True, row[0]
        if pending:
            out.append(pending)
            size += len(pending[2])
            pending = None
        role, text = row[1] or "", escape(row[2] or "")
        head = f"{prefix}{START}{escape_role(role)}\n"
        prefix = f"{head}{text}{END}\n"
        if role == TRAINED:
            pending = (conv, number, prefix, len(head), len(head) + len(text), False)
            number += 1


def format_conversations(turns: DataFrame) -> DataFrame:
    """Training examples of `turns` (`conv_id`, `turn`, `role`, `text`).

    Every assistant turn becomes an example: all turns up to it, formatted, with the code points of
    that reply alone between loss_start and loss_end.  is_whole marks a conversation's last example;
    if its last turn is not an assistant's, a further example without a trainable part holds the whole.
    Texts are escaped so that no control string stands in them; `parse` gives the turns back.

    Turns are in the order of turn (null first), role and text; null roles and texts count as empty; a
    null conv_id is a conversation; an empty table gives no rows; other columns are dropped.  Turns
    of a conversation stream through one task, which holds one formatted conversation.
    """
    frame = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return frame.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, _EXAMPLES)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    loss, chars, formatted, conv, whole = hashlib.sha256(), 0, 0, None, None
    for conv, masked, n_chars, whole in _rows(batches, ("conv_id", "masked", "n_chars", "whole")):
        reply = unescape(masked)
        loss.update(reply.encode())
        chars += len(reply)
        formatted += n_chars
        if whole is not None:
            turns = parse(whole)
            sha = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            out.append((conv, len(turns), sha.hexdigest(), chars, loss.hexdigest(), formatted))
            loss, chars, formatted = hashlib.sha256(), 0, 0
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGEST_ARROW, strict=True)], schema=_DIGEST_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGEST_ARROW, strict=True)], schema=_DIGEST_ARROW)


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the examples say, read back per conversation: turns from the whole one, replies from the masks."""
    masked = F.expr("substring(formatted, CAST(loss_start + 1 AS INT), CAST(loss_end - loss_start AS INT))")
    read = examples.select("conv_id", "example", masked.alias("masked"), F.length("formatted").cast("long").alias("n_chars"), F.when(F.col("is_whole"), F.col("formatted")).alias("whole"))
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_digest, _DIGEST)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digest_examples(format_conversations(given.unionByName(probe)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
sized AS (
  SELECT *, sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
    turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
