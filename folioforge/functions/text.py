"""Text rules as column expressions.

Rules are (pattern, replacement) lists applied in order.  `\\b` and `\\w` are taken over Unicode
letters, digits and the underscore, as in the data's own conventions; Java's defaults are ASCII.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

# Ordered replacement rules, Java syntax.
CONTROL = ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
OCR_RULES: Rules = (
    (r"(?U)(\w+)-\n(\w+)", "$1$2"),
    (r"(?Ui)\bS\.\s*(\d)", "Section $1"),
    (r"(?Ui)\bSec\.\s*(\d)", "Section $1"),
    (r"(?Ui)\bcl\.\s*(\d)", "Clause $1"),
    (r"(?Ui)\bArt\.\s*(\d)", "Article $1"),
    (r"(?U)(?<!\S)\|(?!\S)", " "),
    (r"(?U)\bfl\b", "fi"),
    ("[‘’]", "'"),
    ("[“”]", '"'),
    CONTROL,
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "),
)
HTR_RULES: Rules = (CONTROL, (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
ASR_RULES: Rules = (CONTROL, (r"[ \t]+", " "))
SPEECH_CORRECTIONS: Rules = (
    (r"(?Ui)\bsection\s+1\s+38\b", "Section 138"),
    (r"(?Ui)\bsection\s+one\s+thirty[\s-]eight\b", "Section 138"),
    (r"(?U)\bsection\s+(\d+)\b", "Section $1"),
    (r"(?Ui)\bes\s+see\b", "SC"),
    (r"(?U)\bS\s*\.\s*C\s*\.\b", "SC"),
    (r"(?Ui)\bhigh court\b", "High Court"),
    (r"(?Ui)\bsupreme court\b", "Supreme Court"),
    (r"(?Ui)\bi\s+p\s+c\b", "IPC"),
    (r"(?Ui)\bc\s+r\s+p\s+c\b", "CrPC"),
    (r"(?Ui)\bc\s+p\s+c\b", "CPC"),
    (r"(?Ui)\bn\s*[.,-]?\s*i\s*[.,-]?\s*act\b", "NI Act"),
    (r"(?Ui)\br\s+e\s+r\s+a\b", "RERA"),
    (r"(?U)\b(Section|S\.?)\s{2,}(\d+)\b", "$1 $2"),
)
FUSION_RULES: Rules = (
    CONTROL,
    (r"(?<=[\p{L}\p{N}_])\.(?=[\p{L}\p{N}_])", ". "),
    (r"(?Ui)\b(Section|S\.?|Sec\.?)\s*(\d+)\b", "Section $2"),
    ("[‘’]", "'"),
    ("[“”]", '"'),
    ("[–—]", " - "),
    (r"[ \t]+", " "),
    (r" +\n", "\n"),
    (r"\n{3,}", "\n\n"),
)
MARKER_RULES: Rules = ((r"(?s)\[REVIEW\](.*?)\[/REVIEW\]", "$1"), (r"\[UNCERTAIN\]", ""), (" {2,}", " "))
TAGS = {"OCR": "OCR-DOCUMENT", "HTR": "HTR-HANDWRITING", "ASR": "ASR-VOICE", "TYPED": "TYPED-INPUT"}
DOC_TYPES = (
    ("fir", r"\bFIRST INFORMATION REPORT\b|\bFIR\b"), ("contract", r"\bCONTRACT\b|\bAGREEMENT\b"), ("affidavit", r"\bAFFIDAVIT\b"),
    ("court_order", r"\bCOURT ORDER\b|\bORDER\b.*\bCOURT\b"), ("judgment", r"\bJUDGMENT\b|\bJUDGEMENT\b"), ("notice", r"\bNOTICE\b"),
    ("deed", r"\bDEED\b"), ("writ_petition", r"\bWRIT PETITION\b|\bWRIT\b"),
)
PARTY = (
    r"(?Uis)(?:BETWEEN|PARTY(?:\s+OF)?|PLAINTIFF|DEFENDANT|PETITIONER|RESPONDENT|APPELLANT|versus|vs\.?|V/S)\s*[:\-]?\s*"
    r"([A-Z][A-Za-z\s\.&,]{3,50}(?:Ltd|LLP|Pvt|Inc|Corp|Pvt\. Ltd\.?)?)"
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
JURISDICTIONS = (
    "Delhi", "Mumbai", "Bombay", "Kolkata", "Calcutta", "Chennai", "Madras", "Bangalore", "Bengaluru", "Hyderabad", "Ahmedabad", "Pune", "Jaipur", "Lucknow", "Allahabad", "Patna", "Guwahati", "Chandigarh",
    "Supreme Court", "High Court", "District Court", "Sessions Court", "Magistrate Court", "National Consumer", "NCLAT", "NCLT", "RERA",
    "Andhra Pradesh", "Bihar", "Gujarat", "Haryana", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Punjab", "Rajasthan", "Tamil Nadu", "Telangana", "Uttar Pradesh", "West Bengal",
)
QUESTION_SPEECH = r"what|when|where|who|which|how|why|does|do|is|are|can|could|would|should"
QUESTION_FUSED = r"what|when|where|who|which|how|why|does|do|is|are|can"
INSTRUCTION_SPEECH = r"draft|write|prepare|send|file|submit|create|generate|compose|issue|serve|attach"
INSTRUCTION_FUSED = r"draft|write|prepare|send|file|submit|create|generate|compose|issue"
PRESERVED = (
    r"(?U)\b(IPC|CrPC|CPC|NI Act|IT Act|RERA|NCLT|NCLAT|SC|HC|DC)\b", r"(?Ui)\bS(?:ec(?:tion)?)?\.?\s*\d+", r"(?U)\b\d{4}\s+(?:SCC|AIR|SCR|CLT|Cri LJ)\s+\d+\b",
    r"(?U)\b[A-Z]{2,}\b", r"(?U)\b\d[\d\-/\.]*\b",
)
WORD = r"[\p{L}\p{N}_]+"


def apply_rules(text: Column, rules: Rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def strip(text: Column) -> Column:
    """Without white space, of any kind in Unicode, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def sentences(text: Column) -> Column:
    """Parts that end in `.`, `!` or `?` before white space, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def sentence_tokens(sentence: Column) -> Column:
    """Set of lower-case words outside review spans."""
    outside = F.regexp_replace(sentence, r"(?s)\[REVIEW\].*?\[/REVIEW\]", " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def normalise_ocr(text: Column) -> Column:
    return strip(apply_rules(text, OCR_RULES))


def clean_htr(text: Column) -> Column:
    return strip(apply_rules(text, HTR_RULES))


def clean_asr(text: Column) -> Column:
    return strip(apply_rules(text, ASR_RULES))


def correct_speech(text: Column) -> Column:
    return F.regexp_replace(apply_rules(text, SPEECH_CORRECTIONS), r" {2,}", " ")


def clean_fused(text: Column) -> Column:
    """Fusion's cleaning after NFKC, which Spark lacks; see `operators.fusion.nfkc`."""
    return strip(apply_rules(F.coalesce(text, F.lit("")), FUSION_RULES))


def strip_markers(text: Column) -> Column:
    return apply_rules(text, MARKER_RULES)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def doc_type(text: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(DOC_TYPES):
        found = F.when(text.rlike(f"(?Uid){pattern}"), F.lit(name)).otherwise(found)
    return found


def parties(text: Column) -> Column:
    """Up to six distinct names after a role, in order."""
    names = F.transform(F.regexp_extract_all(text, F.lit(PARTY), F.lit(1)), lambda x: F.regexp_replace(strip(x), ",+$", ""))
    return F.slice(F.array_distinct(F.filter(names, lambda x: x != "")), 1, 6)


def iso_date(text: Column) -> Column:
    """First hit of each of three patterns, in their order, that is a date of the calendar; ISO form."""
    months = "|".join(MONTHS)
    number = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m.lower(), str(i + 1))))
    numeric, day_first, month_first = r"(?U)\b(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{4})\b", rf"(?Ui)\b(\d{{1,2}})\s+({months})\s+(\d{{4}})\b", rf"(?Ui)\b({months})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    get = lambda p, g: F.regexp_extract(text, p, g)
    date = lambda y, m, d: F.concat_ws("-", y, m, d).try_cast("date")
    month = lambda p, g: F.try_element_at(number, F.lower(get(p, g)))
    found = F.coalesce(date(get(numeric, 3), get(numeric, 2), get(numeric, 1)), date(get(day_first, 3), month(day_first, 2), get(day_first, 1)), date(get(month_first, 3), month(month_first, 1), get(month_first, 2)))
    return found.cast("string")


def jurisdiction(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)(" + "|".join(JURISDICTIONS) + ")", 1), F.lit(""))


def metadata(text: Column) -> Column:
    return F.struct(doc_type(text).alias("doc_type"), parties(text).alias("parties"), iso_date(text).alias("date"), jurisdiction(text).alias("jurisdiction"))


def _intent(text: Column, questions: str, instructions: str) -> Column:
    return (
        F.when(is_blank(text), "unknown").when(text.rlike(rf"(?Ui)\b({questions})\b") | text.contains("?"), "question")
        .when(text.rlike(rf"(?Ui)\b({instructions})\b"), "instruction").otherwise("narration")
    )


def speech_intent(text: Column) -> Column:
    return _intent(text, QUESTION_SPEECH, INSTRUCTION_SPEECH)


def fused_intent(text: Column, spoken: Column | None = None) -> Column:
    own = _intent(text, QUESTION_FUSED, INSTRUCTION_FUSED)
    return own if spoken is None else F.coalesce(F.nullif(spoken, F.lit("unknown")), own)


def is_preserved(text: Column) -> Column:
    """Whether a legal token keeps a word from being spell-corrected."""
    test = F.lit(False)
    for pattern in PRESERVED:
        test = test | text.rlike(pattern)
    return test


def review_spans(text: Column) -> Column:
    """Contents of review spans, stripped, blank ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\[REVIEW\](.*?)\[/REVIEW\]"), F.lit(1)), strip), lambda x: x != "")


def mark_review(text: Column, flagged: Column) -> Column:
    return F.when(flagged, F.concat(F.lit("[REVIEW]"), text, F.lit("[/REVIEW]"))).otherwise(text)


def without_tags(text: Column) -> Column:
    """Text for retrieval: modality tags go, each with a newline after it; review marks stay."""
    names = "|".join(TAGS.values())
    return strip(apply_rules(text, ((rf"\[({names})\]\n?", ""), (rf"\[/({names})\]\n?", ""))))
