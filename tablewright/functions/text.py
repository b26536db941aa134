"""Text expressions over one column: log lines, replies, requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TAIL_CHARACTERS = 4000
NOISE_WORDS = ("Warning", "graphviz", "INFO")
NO_ERROR_LINE = "Trigger failed"


WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """White space of every kind off both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def error_tail(c: Column, n: int = TAIL_CHARACTERS) -> Column:
    """The last ``n`` characters, double quotes escaped by a backslash."""
    return F.replace(F.right(c, F.lit(n)), F.lit('"'), F.lit('\\"'))


def last_error(c: Column, default: str | None = NO_ERROR_LINE) -> Column:
    """The last line that is not blank and holds no noise word, trimmed."""
    def meaningful(line: Column) -> Column:
        keep = strip(line) != ""
        for word in NOISE_WORDS:
            keep = keep & ~line.contains(word)
        return keep

    lines = F.filter(F.split(c, "\n"), meaningful)
    return F.coalesce(strip(F.try_element_at(lines, F.lit(-1))), F.lit(default))


def quoted_regex(text: str) -> str:
    """A pattern that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quoted_replacement(text: str) -> str:
    """A replacement that inserts the text itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
