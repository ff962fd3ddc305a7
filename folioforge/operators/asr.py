"""Speech: segments to transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import scores, text
from folioforge.operators import htr

# Fixed values.
SILENCE = 0.6
ENGINES = ("whisper", "faster_whisper")


def is_silence(no_speech: Column, threshold: float = SILENCE) -> Column:
    return no_speech > threshold


def process_segments(segments: DataFrame, engine: str = "whisper", silence: float = SILENCE) -> DataFrame:
    """Segments without silence and blanks, cleaned, corrected, with confidence and review flag.  Silence goes first."""
    heard = segments.where(~is_silence(F.col("no_speech_prob"), silence)).withColumn("text", text.clean_asr(F.col("text"))).where("text <> ''")
    confidence = scores.logprob_confidence(F.col("avg_logprob"))
    tag = engine if engine in ENGINES else "unknown"
    return heard.withColumns({"text": text.correct_speech(F.col("text")), "confidence": confidence, "review_required": scores.review_required(confidence), "asr_engine": F.lit(tag)})


def assemble_transcript(segments: DataFrame, key: str = "document_id", order: str = "segment_id", separator: str = " ") -> DataFrame:
    """Transcript (joined by a blank; by a newline for fusion), flagged count, mean confidence and intent."""
    out = htr.assemble_text(segments, key, order, separator).withColumnsRenamed({"full_text": "transcript", "low_confidence_regions": "low_confidence_segments"})
    return out.withColumn("intent", text.speech_intent(F.col("transcript")))


def duration_s(samples: Column, rate: int = 16_000) -> Column:
    return F.size(samples) / rate
