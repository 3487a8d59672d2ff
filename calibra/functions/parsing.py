"""Reply parsing and scoring as Column expressions.

All built-in functions: they stay in whole-stage codegen, no Python per row.
Regexes are ASCII (Java ``\\s`` / ``\\d``); the reply formats are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibra.schemas import LETTERS

# Fixed patterns of the reply format (case-insensitive, first match wins).
ANSWER_PATTERN = r"(?i)ANSWER:\s*([A-D])"
CONFIDENCE_PATTERN = r"(?i)CONFIDENCE:\s*(\d{1,3})"
# Free-form replies: labelled final answer (label case-sensitive), else the
# last standalone letter A-D of the upper-cased text.
FINAL_ANSWER_PATTERN = r"FINAL_ANSWER:\s*([A-Da-d])"
# a letter between characters that are no letter, digit or underscore in any script
STANDALONE_LETTER_PATTERN = r"(?<![\p{L}\p{N}_])([A-D])(?![\p{L}\p{N}_])"

TRUTHY = ["1", "true", "yes"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x) -> Column:
    """``lower(str(x)) in {1,true,yes}``; anything else, null too, is False."""
    return F.coalesce(F.lower(_c(x).cast("string")).isin(TRUTHY), F.lit(False))


def numeric(x) -> Column:
    """Lenient numeric coercion; unparsable text becomes NULL (ANSI-safe)."""
    return F.trim(_c(x).cast("string")).try_cast("double")


def answer_letter(text) -> Column:
    """First ``ANSWER: X`` (case-insensitive) upper-cased, NULL when absent."""
    return F.nullif(F.upper(F.regexp_extract(_c(text), ANSWER_PATTERN, 1)), F.lit(""))


def confidence_value(text) -> Column:
    """First ``CONFIDENCE: ddd`` (up to three digits); outside 0-100 -> NULL."""
    raw = F.nullif(F.regexp_extract(_c(text), CONFIDENCE_PATTERN, 1), F.lit("")).cast("int")
    return F.when(raw <= 100, raw)


def parse_reply(text) -> dict[str, Column]:
    """Columns predicted_letter, confidence, parse_ok for a reply column.

    A blank or NULL reply matches neither pattern and yields (NULL, NULL, false).
    """
    letter = answer_letter(text)
    conf = confidence_value(text)
    ok = F.coalesce(letter.isNotNull() & conf.isNotNull(), F.lit(False))
    return {"predicted_letter": letter, "confidence": conf, "parse_ok": ok}


def letter_to_index(letter) -> Column:
    """A..D -> 0..3, anything else NULL."""
    pos = F.array_position(F.array(*[F.lit(x) for x in LETTERS]), F.upper(_c(letter)))
    return F.when(pos > 0, (pos - 1).cast("int"))


def index_to_letter(idx) -> Column:
    """0..3 -> A..D, anything else NULL."""
    i = _c(idx).cast("int")
    return F.when((i >= 0) & (i < len(LETTERS)), F.get(F.array(*[F.lit(x) for x in LETTERS]), i))


def is_correct(letter, answer_index) -> Column:
    """Predicted letter maps to the answer index; unparsed -> False."""
    return F.coalesce(letter_to_index(letter) == _c(answer_index), F.lit(False))


def final_letter(text) -> Column:
    """Labelled FINAL_ANSWER letter, else the last standalone A-D."""
    labelled = F.nullif(F.upper(F.regexp_extract(_c(text), FINAL_ANSWER_PATTERN, 1)), F.lit(""))
    fallback = F.try_element_at(
        F.regexp_extract_all(F.upper(_c(text)), F.lit(STANDALONE_LETTER_PATTERN), F.lit(1)),
        F.lit(-1))
    return F.coalesce(labelled, fallback)


def strip(x) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def content_key(subject, question) -> Column:
    """``subject || '||' || strip(question)``."""
    return F.concat(_c(subject).cast("string"), F.lit("||"), strip(question))


def truncate_reply(text, n: int = 800) -> Column:
    """reply[:n] with NULL -> ''."""
    return F.substring(F.coalesce(_c(text), F.lit("")), 1, n)
