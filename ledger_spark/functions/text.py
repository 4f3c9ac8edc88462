"""Statement-text cleaning and literal search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four rewrites, in the order they apply. ``(?U)`` makes the
# digit and space classes cover all of Unicode.
TEXT_REWRITES = (
    (r"(?U)Page \d+ of \d+", ""),
    (r"(?U)[\s\x1c-\x1f]+", " "),
    (r"(?U)l(\d)", "1$1"),
    (r"(?U)O(\d)", "0$1"),
)


def clean_text(text: Column) -> Column:
    """Drop page markers, collapse white space, repair l/O before digits."""
    for pattern, replacement in TEXT_REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def contains_term(text: Column, term: str) -> Column:
    """True where ``text`` holds ``term`` literally, ignoring case; null is false."""
    return F.coalesce(F.contains(F.lower(text), F.lower(F.lit(term))), F.lit(False))


def before_last(text: Column, mark: str) -> Column:
    """Everything before the last occurrence of ``mark`` (present by contract)."""
    tail = F.substring_index(text, mark, -1)
    return F.left(text, F.length(text) - F.length(tail) - F.lit(len(mark)))
