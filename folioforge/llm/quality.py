"""Quality rules: line-first cleaning, then rejection of documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import blocks as B
from folioforge.llm.staging import bound_batches
from folioforge.sources.files import table

# Fixed values.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "use of cookies",
    "uses cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "skip to content", "back to top",
    "sign up for our newsletter", "click here to",
)
NAVIGATION_MARKS = ("|", "»", "«", "›", "•", "·", ">", "/")
TERMINALS = ".!?…:;。！？"
#: Marks that end a sentence in other scripts, by Unicode's Sentence_Terminal, with the Tibetan shads: escapes,
#: as many editors show none of them.
OTHER_TERMINALS = (
    "\u0589\u061d\u061e\u061f\u06d4\u0700\u0701\u0702\u07f9\u0837\u0839\u083d\u083e\u0964\u0965\u0f0d\u0f0e\u104a\u104b\u1362\u1367\u1368\u166e\u1735\u1736"
    "\u17d4\u17d5\u1803\u1809\u1944\u1945\u1aa8\u1aa9\u1aaa\u1aab\u1b5a\u1b5b\u1b5e\u1b5f\u1b7d\u1b7e\u1b7f\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047\u2048\u2049"
    "\u2cf9\u2cfa\u2cfb\u2e2e\u2e3c\u2e53\u2e54\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d\uaa5e\uaa5f\uaaf0\uaaf1\uabeb"
    "\ufe12\ufe15\ufe16\ufe52\ufe56\ufe57\uff0e\uff61\u037e"
    "\U00010a56\U00010a57\U00010f55\U00010f56\U00010f57\U00010f58\U00010f59\U00010f86\U00010f87\U00010f88\U00010f89\U00011047\U00011048\U000110be\U000110bf\U000110c0"
    "\U000110c1\U00011141\U00011142\U00011143\U000111c5\U000111c6\U000111cd\U000111de\U000111df\U00011238\U00011239\U0001123b\U0001123c\U000112a9\U0001144b\U0001144c"
    "\U000115c2\U000115c3\U000115c9\U000115ca\U000115cb\U000115cc\U000115cd\U000115ce\U000115cf\U000115d0\U000115d1\U000115d2\U000115d3\U000115d4\U000115d5\U000115d6\U000115d7\U00011641\U00011642\U0001173c\U0001173d\U0001173e\U00011944\U00011946\U00011a42\U00011a43\U00011a9b\U00011a9c\U00011c41\U00011c42\U00011ef7"
    "\U00011ef8\U00011f43\U00011f44\U00016a6e\U00016a6f\U00016af5\U00016b37\U00016b38\U00016b44\U00016e98\U0001bc9f\U0001da88"
)
CLOSERS = "\"')]}”’»*_"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; a document keeps its place if it keeps `min_kept` of its words."""

    min_words: int = 10
    max_repeat_percent: int = 20
    long_line_words: int = 8
    symbol_percent: int = 30
    bang_percent: int = 30
    mark_count: int = 3
    mark_percent: int = 20
    min_kept_percent: int = 50
    #: Whether a sentence may end as in any script: with its own mark, and in Thai and Lao without one.
    any_script: bool = False


#: The rules of a stage that drops documents: op5's, but sentences may end as in any script.
STAGE = LineRules(any_script=True)


_boilerplate = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_symbols = re.compile(rb"[#*$%&|<>]")
_marks = frozenset(m.encode() for m in NAVIGATION_MARKS)
_sentence_end = re.compile("(?:{})(?:{})*(?:[\\x20\\x09-\\x0D]|$)".format("|".join(map(re.escape, TERMINALS)), "|".join(map(re.escape, CLOSERS))).encode())
_other_end = re.compile(rf"[{OTHER_TERMINALS}][{re.escape(CLOSERS)}]*(?:[\x20\x09-\x0D]|$)")
_no_marks = re.compile("[\u0e00-\u0eff]")  # Thai and Lao
_visible = re.compile("[^\\x20\\x09-\\x0D]")
_suspect = re.compile("|".join(map(re.escape, (*NAVIGATION_MARKS, *SYMBOLS, "!!"))).encode())
_TEXT_SYMBOLS = np.zeros(256, bool)
_TEXT_SYMBOLS[[ord(c) for c in SYMBOLS]] = True


def _ends_otherwise(line: str) -> bool:
    """Whether a word ends a sentence by a mark of another script, or half of the signs are of one that has none."""
    return bool(_other_end.search(line)) or 2 * len(_no_marks.findall(line)) >= len(_visible.findall(line))


def line_fault(line: bytes, words: list[bytes], rules: LineRules, phrases: bool = True) -> str | None:
    """The rule that a line breaks: punctuation, navigation or boilerplate; None for good and blank lines.

    `words` is `line.split()`, which for bytes splits at exactly the separators of the word class;
    `phrases` False says that the text holds no boilerplate phrase anyway.
    """
    n = len(words)
    if not n:
        return None
    if _suspect.search(line):
        marks = sum(w in _marks for w in words)
        if marks >= rules.mark_count and 100 * marks >= rules.mark_percent * n:
            return "navigation"
        if n > 2 and 100 * len(_symbols.findall(line)) >= rules.symbol_percent * n:
            return "punctuation"
        if n > 2 and 100 * sum(w.endswith(b"!!") for w in words) >= rules.bang_percent * n:
            return "punctuation"
    if n >= rules.long_line_words and not _sentence_end.search(line) and not (rules.any_script and not line.isascii() and _ends_otherwise(line.decode())):
        return "punctuation"
    if phrases and _boilerplate.search(line.lower()):
        return "boilerplate"
    return None


def _repeated(gram: np.ndarray, n: int) -> int:
    """Words covered by five-word windows that stand in the text twice or more."""
    if len(gram) < 2:
        return 0
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def _cleaned(text: bytes, rules: LineRules) -> tuple[bytes, int, int, int]:
    """Clean text, words that remain, faulty lines, repeated lines."""
    kept, seen, faults, repeats, left = [], set(), 0, 0, 0
    phrases = bool(_boilerplate.search(text.lower()))
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            repeats += line in seen
            seen.add(line)
        if line_fault(line, words, rules, phrases) is None:
            kept.append(line)
            left += len(words)
        else:
            faults += 1
    return b"\n".join(kept) if faults else text, left, faults, repeats


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, clean_text string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_bad_lines", pa.int64()), ("clean_text", pa.string())])


def _judge(rules: LineRules, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for block in B.text_blocks(texts):
                words = B.split_words(block, B.SPACED)
                gram = B.grams(words.hashes, 5)
                heads = np.zeros(len(block.data) + 1, np.int64)
                np.cumsum((block.data & 0xC0) != 0x80, out=heads[1:])
                chars = np.zeros(len(words.starts) + 1, np.int64)
                np.cumsum(heads[words.ends] - heads[words.starts], out=chars[1:])
                signs = np.zeros(len(block.data) + 1, np.int64)
                np.cumsum(_TEXT_SYMBOLS[block.data], out=signs[1:])
                n_words = np.diff(words.bounds)
                rows = []
                for r in range(block.rows):
                    text = block.data[block.offsets[r] : block.offsets[r + 1]].tobytes()
                    low, n = words.bounds[r], int(n_words[r])
                    repeat = _repeated(gram[low : low + n - 4], n) if n > 5 else 0
                    clean, left, faults, dups = _cleaned(text, rules)
                    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
                    kept = not failed and 100 * left >= rules.min_kept_percent * n
                    rows.append((dups, repeat, failed, kept, faults, clean))
                dups, repeats, failed, kept, faults, clean = zip(*rows, strict=True)
                columns = [
                    ids.slice(block.first, block.rows), pa.array(n_words, pa.int64()), pa.array(np.diff(chars[words.bounds])),
                    pa.array(np.diff(signs[block.offsets])), pa.array(dups, pa.int64()), pa.array(repeats, pa.int64()),
                    pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(faults, pa.int64()), pa.array(clean, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).slice(block.first, block.rows) for c in extra)], [*_ARROW.names, *extra])

    return run


def judge_documents(docs: DataFrame, rules: LineRules = LineRules(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, verdict and clean text for each row of `docs` (`doc_id`, `text`).

    Every line is tested by itself: navigation (a share of separator marks), punctuation
    (symbol litter, shouted words, a long line in which no word ends a sentence) and boilerplate
    phrases.  Faulty lines go, and a document is rejected if less than
    `rules.min_kept_percent` of its words remain, or if it fails the base rules
    (few words, repeated five-word windows).

    A null text counts as empty and is rejected; a null doc_id stays null; repeated rows
    are judged row by row; an empty table gives no rows.  A text of any length is read whole; memory
    follows the longest text.  Other columns are dropped, save
    those in `carry`, whose names must differ from the result's.  No shuffle.
    """
    bound_batches(docs.sparkSession)
    extra = [f"_carry_{c}" for c in carry]
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)))
    schema = OUT + "".join(f", `{e}` {frame.schema[e].dataType.simpleString()}" for e in extra)
    out = frame.mapInArrow(_judge(rules, extra), schema)
    for c, e in zip(carry, extra, strict=True):
        out = out.withColumnRenamed(e, c)
    return out


def filter_documents(docs: DataFrame, rules: LineRules = STAGE) -> DataFrame:
    """The documents that pass, whatever script they are in, with their clean text and the columns doc_id, text, lang, source, n_chars.

    Null and empty texts fail; null and repeated ids and repeated rows are judged row by row; an empty table gives no rows.
    """
    judged = judge_documents(docs, rules, carry=("lang", "source")).where("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, f"{sf_dir}/documents.parquet")).drop("clean_text")


_W = r"'[^\x20\x09-\x0D]+'"
_MARK_LIST = ", ".join(f"'{m}'" for m in NAVIGATION_MARKS)
_PHRASES = "|".join(BOILERPLATE)
SQL = rf"""
WITH lines AS (
  SELECT doc_id, line, regexp_extract_all(line, {_W}) AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
judged AS (
  SELECT *, len(w) AS n, len(w) > 0 AND (
      len(list_filter(w, lambda x: x IN ({_MARK_LIST}))) >= 3 AND 100 * len(list_filter(w, lambda x: x IN ({_MARK_LIST}))) >= 20 * len(w)
      OR len(w) > 2 AND 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) >= 30 * len(w)
      OR len(w) > 2 AND 100 * len(list_filter(w, lambda x: ends_with(x, '!!'))) >= 30 * len(w)
      OR len(w) >= 8 AND NOT regexp_matches(line, '[.!?…:;。！？]["'')\]}}”’»*_]*([\x20\x09-\x0D]|$)')
      OR regexp_matches(lower(line), '{_PHRASES}')) AS bad
  FROM lines),
per_line AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS BIGINT) AS left_words, count(*) FILTER (WHERE bad) AS n_bad_lines,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines, CAST(coalesce(sum(list_sum(list_transform(w, lambda x: length(x)))), 0) AS BIGINT) AS word_chars
  FROM judged GROUP BY doc_id),
grams AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents) WHERE len(w) > 4)),
twice AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1) GROUP BY doc_id),
base AS (
  SELECT doc_id, n_words, word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_bad_lines, left_words,
    n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed
  FROM documents JOIN per_line USING (doc_id) LEFT JOIN twice USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * left_words >= 50 * n_words AS kept, n_bad_lines FROM base
"""
