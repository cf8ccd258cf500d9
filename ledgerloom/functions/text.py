"""Text expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(text: Column) -> Column:
    """Drop every white space, Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def swap_quotes(text: Column) -> Column:
    """Double quotes become single ones."""
    return F.translate(text, '"', "'")


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only; other letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def icontains(column: Column, text: str) -> Column:
    """Case-insensitive (ASCII) substring test. A NULL column never matches, even for ''."""
    return F.contains(ascii_lower(column), F.lit(_ascii_lower(text)))


def any_contains(text: str, *columns: str) -> Column:
    """``icontains`` over several columns, OR-ed."""
    test = icontains(F.col(columns[0]), text)
    for name in columns[1:]:
        test = test | icontains(F.col(name), text)
    return test


def raw_like(column: Column, pattern: str) -> Column:
    """SQL LIKE folding ASCII case; ``%`` and ``_`` act, a backslash is literal."""
    return ascii_lower(column).like(_ascii_lower(pattern).replace("\\", "\\\\"))


def pipe_row(*columns: Column) -> Column:
    """``a|b|c``; NULL prints as 'None'."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns])


def pipe_split(line: Column) -> Column:
    return F.split(line, r"\|")


def size_array(size: Column) -> Column:
    """'230,180' -> [230, 180]; pieces that are no integer become NULL."""
    return F.transform(F.split(size, ","), lambda x: x.try_cast("int"))
