"""Text of rows, labels, paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = r"^[A-Za-z_][A-Za-z0-9_]*(\[\d+\])?$"


def masked_digits(text: Column) -> Column:
    """Every run of digits as one #."""
    return F.regexp_replace(text, r"\d+", "#")


def slug(text: Column, length: int = 30) -> Column:
    """Letters and digits kept, everything else an underscore, cut to ``length``."""
    return F.left(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), F.lit(length))


def settled_terms(text: Column) -> Column:
    """The terms a contract's payment clause names, null without one."""
    return F.nullif(F.regexp_extract(text, r"settled on (Net \d+) terms", 1), F.lit(""))


def after_first_word(text: Column) -> Column:
    """What follows the first word, or the text itself if it has only one."""
    rest = F.regexp_extract(text, r"^\s*\S+\s+(.*)$", 1)
    return F.when(rest != "", rest).otherwise(F.trim(text))


def after_dot(text: Column) -> Column:
    """What follows the first full stop, or the text itself if it has none."""
    return F.trim(F.regexp_replace(text, r"^[^.]*\.", ""))


def is_heading(text: Column, most_words: int = 3) -> Column:
    """All capitals and at most a few words."""
    return (F.upper(text) == text) & (F.lower(text) != text) & (F.size(F.split(F.trim(text), r"\s+")) <= most_words)


def valid_path(path: Column) -> Column:
    """Dotted names, each with at most one index in brackets."""
    return F.forall(F.split(path, r"\."), lambda s: s.rlike(SEGMENT))


def described_position(page: Column, x0: Column, y0: Column) -> Column:
    """A position for readers: pages count from 1 there."""
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    return F.concat(F.lit("p"), (page + 1).cast("string"), F.lit(" ["), whole(x0), F.lit(","), whole(y0), F.lit("]"))
