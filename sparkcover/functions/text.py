"""Column functions for text: line split, word split, character split.

All three are built-in expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line terminators a Hadoop text scan recognises, as a regex.
LINE_BREAK_PATTERN = r"\r\n|\n|\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_lines(text: Column | str) -> Column:
    """Lines of a text value, as a line-oriented file scan would produce them.

    Split on CR LF, LF or CR. A final terminator does not open an extra empty
    line, so the last element is dropped when it is empty: ``"a\\n"`` gives
    ``["a"]``, ``"a\\n\\n"`` gives ``["a", ""]`` and ``""`` gives ``[]``.
    """
    parts = F.split(_col(text), LINE_BREAK_PATTERN)
    return F.when(
        F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def split_words(line: Column | str) -> Column:
    """Words of a line split on single spaces, with the JVM ``String.split(" ")`` rules.

    Leading and interior empty words are kept, trailing empty words are dropped,
    an empty line gives one empty word and an all-space line gives none. Tabs and
    other whitespace stay inside words.
    """
    line = _col(line)
    trimmed = F.rtrim(line)
    return (
        F.when(line == F.lit(""), F.array(F.lit("")))
        .when(trimmed == F.lit(""), F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, " "))
    )


def split_chars(word: Column | str) -> Column:
    """Characters (code points) of a word; the empty word has none."""
    return F.filter(F.split(_col(word), ""), lambda ch: ch != F.lit(""))
