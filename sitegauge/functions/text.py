"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space: as a class that RE2 knows too, and character by character.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(text, F.lit(WHITE))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda x: x != "")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines of a text by any line end; an empty last one is no line."""
    return F.split(F.regexp_replace(text, rf"({LINE_END})\z", ""), LINE_END, -1)


def percent(k: Column, of: int) -> Column:
    """k of `of` as a whole percentage."""
    return F.concat(F.round(k * 100 / of).cast("int").cast("string"), F.lit("%"))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
