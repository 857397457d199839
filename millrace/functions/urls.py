"""Hosts and registrable domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels under which countries register names, so that they make a public suffix with a country's label of two letters.
SECOND_LEVEL = ["ac", "asn", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gub", "gv", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch", "school"]
# Countries that register names only right under their label.
FLAT = ["be", "ca", "cc", "ch", "cz", "de", "dk", "eu", "fi", "li", "lu", "nl", "no", "si", "tv", "us"]
# Further public suffixes of two labels.
FURTHER = ["ac.be", "blogspot.com", "cloudfront.net", "gc.ca", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app"]


def host(url: Column) -> Column:
    """The lower-cased host name without port; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(h, F.lit(""))


def is_suffix(two: Column, suffixes: list[str] | None = None) -> Column:
    """Whether two labels are a public suffix: by the rule of SECOND_LEVEL, FLAT and FURTHER, or where a list of all suffixes of two labels is given, by it."""
    if suffixes is not None:
        return two.isin(suffixes)
    return two.rlike(rf"^(?:{'|'.join(SECOND_LEVEL)})\.(?!(?:{'|'.join(FLAT)})$)[a-z][a-z]$") | two.isin(FURTHER)


def registrable_domain(url: Column, suffixes: list[str] | None = None) -> Column:
    """The public suffix of a url's host and the label before it; null for a bare suffix or no host."""
    h = host(url)
    two = F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return F.nullif(F.when(is_suffix(two, suffixes), three).otherwise(two), F.lit(""))
