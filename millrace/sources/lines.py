"""Lines of texts, and the site of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind, as a class of Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def squeezed(text: Column) -> Column:
    """The text in lower case, each run of white space as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE + "+", " ")))


def site_of(url: Column) -> Column:
    """The last two labels of the lower-cased host; null where there is no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@\\]*@)?([^/?#:\\]+)", 1)), r"\.+$", "")
    return F.nullif(F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1), F.lit(""))


def line_hashes(text: Column) -> Column:
    """For each line between line feeds the 64-bit hash of its squeezed form, null for an empty one."""
    lines = F.transform(F.split(text, "\n", -1), squeezed)
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))
