"""Text functions as JVM expressions with exact code-point semantics; NFKC alone needs an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Python's str methods and regular expressions, as a class body.
PYWS = r"\t\n\x0B\f\r\x1c-\x1f\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Han and kana ranges of the script test, as a class body.
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"
    r"\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}"
)
LATIN = r"A-Za-z\x{C0}-\x{24F}"
# Patterns and replacements of the cleaning chain.
TAG = r"<[^>]+>"
URL = rf"https?://[^{PYWS}]+|www\.[^{PYWS}]+"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
ASCII_MARKS, WIDE_MARKS = "!?,.:;()", "！？、。：；（）"
# Marks that answer comparison may ignore.
ANSWER_MARKS = r"""[。、！？「」『』（）・…ー〜.,!?:;'"\-()\[\]{}]"""


def nfkc(text: Column | str) -> Column:
    """NFKC normalisation; null stays null."""

    @F.pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    # Else a filter on the result would be moved below the projection and compute it a second time.
    return normalise.asNondeterministic()(text)


def strip(text: Column) -> Column:
    """Removes white space at both ends as Python's ``str.strip`` does."""
    return F.regexp_replace(text, f"^[{PYWS}]+|[{PYWS}]+$", "")


def remove_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def remove_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def widen_marks(text: Column) -> Column:
    return F.translate(text, ASCII_MARKS, WIDE_MARKS)


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def clean(text: Column, normalise: bool = True) -> Column:
    """The cleaning chain: NFKC, tags, URLs, controls, full-width marks, blanks, strip."""
    text = nfkc(text) if normalise else text
    return strip(collapse_blanks(widen_marks(remove_controls(remove_urls(remove_tags(text))))))


def script_ratio(text: Column, script: str = CJK) -> Column:
    """Share of code points in a class body; 0 for empty text."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(f"[{script}]")), F.length(text)), F.lit(0.0))


def answer_form(text: Column, lower: bool = True, normalise: bool = True) -> Column:
    """Form in which answers are compared: NFKC, no white space, lower case on demand."""
    text = F.regexp_replace(nfkc(text) if normalise else text, f"[{PYWS}]+", "")
    return F.lower(text) if lower else text


def remove_answer_marks(text: Column) -> Column:
    return F.regexp_replace(text, ANSWER_MARKS, "")


def japanese_share(text: Column) -> Column:
    """Kana and common Han over all code points but spaces; 0 for none."""
    found = F.regexp_count(text, F.lit(r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]"))
    return F.coalesce(F.try_divide(found, F.length(F.replace(text, F.lit(" "), F.lit("")))), F.lit(0.0))


def has_run(text: Column, length: int = 10) -> Column:
    """Whether a character other than a line feed stands ``length`` times in a row."""
    return text.rlike(rf"(.)\1{{{length - 1},}}")


def prefix(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def subject_title(subject: Column) -> Column:
    """Subject with blanks for underscores; a general title if there is none."""
    return F.coalesce(F.nullif(F.replace(subject, F.lit("_"), F.lit(" ")), F.lit("")), F.lit("一般知識"))
