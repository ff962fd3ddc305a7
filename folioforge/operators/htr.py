"""Handwriting: region suppression, spelling, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import scores, text

# Fixed values.
DEVANAGARI = ("hi", "mr", "ne", "sa")
ENGINES = ("trocr", "tesseract_devanagari", "mock")


def engine_for(language: Column, override: str | None = None) -> Column:
    return F.lit(override) if override else F.when(language.isin(*DEVANAGARI), "tesseract_devanagari").otherwise("trocr")


def engine_tag(name: Column) -> Column:
    return F.when(name.isin(*ENGINES), name).otherwise("unknown")


def suppress_overlaps(regions: Column, threshold: float = 0.3) -> Column:
    """Greedy non-maximum suppression over array<struct<x0,y0,x1,y1,score,...>> of a page.

    Best score first, equal scores in their order; a region stays if it overlaps no region kept before
    by more than `threshold`.
    """
    ranked = F.transform(regions, lambda r, i: F.struct((-r["score"]).alias("k"), i.alias("i"), r.alias("r")))
    ordered = F.transform(F.array_sort(ranked), lambda x: x["r"])
    none = F.filter(regions, lambda r: F.lit(False))
    return F.aggregate(ordered, none, lambda kept, r: F.when(F.exists(kept, lambda k: scores.iou(k, r) > threshold), kept).otherwise(F.concat(kept, F.array(r))))


def _deletes(word: Column) -> Column:
    """The word and every form with one character left out."""
    size = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))
    return F.array_distinct(F.concat(F.array(word), cut))


def correct_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Best suggestion for each row of `words` (`word`) from `dictionary` (`term`, `frequency`): adds `corrected`.

    At most one edit (a transposition counts as one), nearest first, then most frequent; preserved legal
    tokens and words without a Latin letter stay, as do words without a suggestion.  Candidates meet
    on forms with a character deleted, an equi-join; an empty dictionary changes nothing.
    """
    distinct = words.select("word").distinct().where(F.col("word").rlike("[a-zA-Z]") & ~text.is_preserved(F.col("word")))
    asked = distinct.select("word", F.lower("word").alias("low")).select("word", "low", F.explode(_deletes(F.col("low"))).alias("form"))
    known = dictionary.select("term", "frequency", F.explode(_deletes(F.col("term"))).alias("form"))
    met = asked.join(known, "form").select("word", "low", "term", "frequency").distinct()
    swapped = (F.length("low") == F.length("term")) & (F.array_sort(F.split("low", "")) == F.array_sort(F.split("term", ""))) & (F.levenshtein("low", "term") == 2)
    distance = F.when(F.col("low") == F.col("term"), 0).when(F.levenshtein("low", "term") == 1, 1).when(swapped, 1)
    best = met.withColumn("distance", distance).where("distance IS NOT NULL").groupBy("word").agg(F.min(F.struct("distance", -F.col("frequency"), "term"))["term"].alias("term"))
    upper = (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word"))
    capital = F.substring("word", 1, 1) != F.lower(F.substring("word", 1, 1))
    cased = F.when(upper, F.upper("term")).when(capital, F.concat(F.upper(F.substring("term", 1, 1)), F.lower(F.expr("substring(term, 2)")))).otherwise(F.col("term"))
    return words.join(best, "word", "left").withColumn("corrected", F.coalesce(cased, "word")).drop("term")


def spell_correct(rows: DataFrame, dictionary: DataFrame, key: str = "region_id") -> DataFrame:
    """`text` of each row with its words corrected and joined by single blanks."""
    words = rows.select(key, F.posexplode(text.tokens(F.col("text"))).alias("pos", "word"))
    fixed = correct_words(words, dictionary).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "corrected"))), lambda w: w["corrected"]), " ").alias("_fixed"))
    return rows.join(fixed, key, "left").withColumn("text", F.coalesce("_fixed", "text")).drop("_fixed")


def process_regions(regions: DataFrame) -> DataFrame:
    return regions.withColumns({"text": text.clean_htr(F.col("text")), "review_required": scores.review_required(F.col("confidence"))})


def assemble_text(regions: DataFrame, key: str = "document_id", order: str = "pos", separator: str = "\n") -> DataFrame:
    """Texts in order, blanks skipped, flagged ones marked for review, and the number of flagged regions."""
    body = text.strip(F.col("text"))
    shown = F.when(body != "", F.struct(order, text.mark_review(body, F.col("review_required")).alias("_t")))
    return regions.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["_t"]), separator).alias("full_text"),
        F.count_if("review_required").alias("low_confidence_regions"),
        scores.mean_confidence_agg(F.col("confidence")).alias("mean_confidence"),
    )


def flagged_regions(regions: Column) -> Column:
    return F.filter(regions, lambda r: r["review_required"])


def regions_by_type(regions: Column, kind: str) -> Column:
    return F.filter(regions, lambda r: r["type"] == kind)
