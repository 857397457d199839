"""Fields of listings found in free text and in structured JSON-LD postings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import trimmed

# Fields of study, in the order they are reported.
FIELDS_OF_STUDY = [
    "computer science", "software engineering", "electrical engineering", "mechanical engineering", "civil engineering", "chemical engineering", "biomedical engineering", "data science", "statistics",
    "mathematics", "physics", "chemistry", "biology", "computational biology", "environmental science", "public health", "economics", "business", "finance", "psychology", "political science", "sociology",
    "history", "english", "linguistics", "art", "design",
]
# The words by which a degree level is known.
DEGREE_LEVELS = {
    "undergraduate": ["undergraduate", "bachelor's", "bachelors", "bachelor"],
    "graduate": ["graduate student", "master's", "masters", "master's degree"],
    "phd": ["phd", "ph.d", "doctoral", "doctorate"],
    "postdoc": ["postdoc", "postdoctoral", "post-doctoral"],
}
# The words that make a listing remote.
REMOTE = ["remote", "work from home", "telecommute", "virtual position", "work-from-home"]
# The phrases before a deadline, in the order they are tried.
DEADLINE_PHRASES = ["deadline", "apply by", "applications close", "applications due", "due by", "must apply by"]
# Bytes after a phrase within which its date is sought, and the names of the months.
DEADLINE_WINDOW = 60
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def mentions(text: Column, word: str) -> Column:
    """Whether a text holds a word or its plural, in any case, between ASCII word boundaries."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in word)
    return text.rlike(rf"(?i)(?<![0-9A-Za-z_]){quoted}s?(?![0-9A-Za-z_])")


_EVERY = sorted({*FIELDS_OF_STUDY, *(w for ws in DEGREE_LEVELS.values() for w in ws), *REMOTE}, key=lambda w: (-len(w), w))
_ANY = "(?i)(?<![0-9A-Za-z_])(" + "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in w) for w in _EVERY) + ")s?(?![0-9A-Za-z_])"


def _holds(word: str, part: str) -> bool:
    return re.search(rf"(?<![0-9a-z_]){re.escape(part)}s?(?![0-9a-z_])", word) is not None


#: What a found word names: itself, and the words within it.
_NAMED = {w: [p for p in _EVERY if _holds(w, p)] for w in _EVERY}


def named(text: Column) -> Column:
    """All words of the three lists that a text holds, in one reading of it."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(1)), lambda w: F.lower(w)))
    within = F.create_map(*[x for w, ps in _NAMED.items() for x in (F.lit(w), F.array(*[F.lit(p) for p in ps]))])
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.try_element_at(within, w))))


def studies_of(words: Column) -> Column:
    """The fields of study among the words of `named`."""
    return F.filter(F.array(*[F.lit(k) for k in FIELDS_OF_STUDY]), lambda k: F.array_contains(words, k))


def levels_of(words: Column) -> Column:
    """The degree levels that the words of `named` mean."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), F.lit(k)) for k, ws in DEGREE_LEVELS.items()]))


def remote_of(words: Column) -> Column:
    """Whether one of the words of `named` speaks of remote work."""
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in REMOTE]))


def fields_of_study(text: Column) -> Column:
    """The fields of study that a text names."""
    return studies_of(named(text))


def degree_levels(text: Column) -> Column:
    """The degree levels that a text names."""
    return levels_of(named(text))


def is_remote(text: Column) -> Column:
    """Whether a text speaks of remote work."""
    return remote_of(named(text))


_DATE = rf"(?i)(?:({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(\d{{4}})|(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}))"


def free_date(text: Column) -> Column:
    """The date first written in a text as `Month D, YYYY` or `M/D/YYYY`; days beyond the month roll over, months must exist."""
    group = lambda i: F.regexp_extract(text, _DATE, i)
    number = lambda i: group(i).try_cast("int")
    month = F.coalesce(F.try_element_at(F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))]), F.lower(group(1))), F.when(number(4).between(1, 12), number(4)))
    year, day = F.coalesce(number(3), number(6)), F.coalesce(number(2), number(5))
    return F.when(month.isNotNull() & (year > 0), F.date_add(F.make_date(year, month, F.lit(1)), day - 1))


def deadline(text: Column) -> Column:
    """The first date that stands within DEADLINE_WINDOW bytes after one of the phrases, at each one's first occurrence.

    The phrase is sought in the text itself, ASCII letters in any case, so the place fits also where lower-casing changes lengths.
    """
    tries = []
    for p in DEADLINE_PHRASES:
        at = F.regexp_instr(text, F.lit(f"(?i){p}"))
        rest = F.encode(F.substring(text, at, F.lit(len(p) + DEADLINE_WINDOW)), "UTF-8")
        tries.append(F.when(at > 0, free_date(F.make_valid_utf8(F.substring(rest, 1, len(p) + DEADLINE_WINDOW).cast("string")))))
    return F.coalesce(*tries)


# JSON-LD postings; `v` is a VARIANT.

_KINDS = {"@type": "STRING", "datePosted": "STRING", "validThrough": "STRING", "jobLocationType": "STRING"}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_posting(v: Column) -> Column:
    right = F.lit(True)
    for k, kind in _KINDS.items():
        part = F.try_variant_get(v, f"$['{k}']" if k.startswith("@") else f"$.{k}", "variant")
        right = right & (part.isNull() | F.is_variant_null(part) | (_kind(part) == kind))
    org = F.try_variant_get(v, "$.hiringOrganization", "variant")
    right = right & (org.isNull() | F.is_variant_null(org) | _kind(org).startswith("OBJECT"))
    return _kind(v).startswith("OBJECT") & right & (F.lower(_get(v, "$['@type']")) == "jobposting")


def job_posting(block: Column) -> Column:
    """The job posting of a JSON-LD block, as VARIANT: the object itself, or the first of a top-level array; else null."""
    v = F.try_parse_json(block)
    items = F.try_variant_get(v, "$", "array<variant>")
    first = F.try_element_at(F.filter(items, _is_posting), F.lit(1))
    return F.when(_is_posting(v), v).otherwise(first)


def json_date(text: Column) -> Column:
    """A date or time of JSON-LD: with offset, local (taken as UTC), or a date; else null."""
    s = trimmed(text)
    stamp = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$")
    return F.when(stamp | s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s)).cast("timestamp_ntz")


def address(place: Column) -> Column:
    """`locality, region` of a place, or what there is of it."""
    return F.concat_ws(", ", F.nullif(_get(place, "$.address.addressLocality"), F.lit("")), F.nullif(_get(place, "$.address.addressRegion"), F.lit("")))


def job_location(posting: Column) -> Column:
    """The location of a posting: of its place, or of the first of several that has one; else empty."""
    many = F.try_variant_get(posting, "$.jobLocation", "array<variant>")
    first = F.try_element_at(F.filter(F.transform(many, address), lambda x: x != ""), F.lit(1))
    return F.coalesce(F.nullif(address(F.try_variant_get(posting, "$.jobLocation", "variant")), F.lit("")), first, F.lit(""))


def education(posting: Column) -> Column:
    """The education a posting requires: a text, or an object's credentialCategory, else its name; else empty."""
    e = F.try_variant_get(posting, "$.educationRequirements", "variant")
    return F.when(_kind(e) == "STRING", _get(posting, "$.educationRequirements")).otherwise(
        F.coalesce(F.nullif(_get(posting, "$.educationRequirements.credentialCategory"), F.lit("")), _get(posting, "$.educationRequirements.name"), F.lit(""))
    )


def organization(posting: Column) -> Column:
    """The hiring organization's name, or empty."""
    return F.coalesce(_get(posting, "$.hiringOrganization.name"), F.lit(""))


def telecommute(posting: Column) -> Column:
    """Whether a posting is for telecommuting."""
    return F.coalesce(F.upper(_get(posting, "$.jobLocationType")) == "TELECOMMUTE", F.lit(False))


def combined_text(title: Column, abstract: Column, content: Column) -> Column:
    """The text in which fields are sought."""
    return F.concat_ws(" . ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), F.coalesce(content, F.lit("")))


def with_listing_fields(df, blocks: str = "json_ld"):
    """`df` (title, abstract, content, and an array of JSON-LD blocks) with the listing's fields.

    A posting's own values come first; deadline, degree levels and remote fall back to the text; fields of study are always of the text,
    location, organization and posted_at never. The first block that is a posting counts.
    """
    posting = F.try_element_at(F.filter(F.transform(F.coalesce(F.col(blocks), F.array().cast("array<string>")), job_posting), lambda v: v.isNotNull()), F.lit(1))
    text = combined_text(F.col("title"), F.col("abstract"), F.col("content"))
    df = df.withColumn("_posting", posting).withColumn("_text", text).withColumn("_named", named(F.col("_text")))
    p, t, words = F.col("_posting"), F.col("_text"), F.col("_named")
    taught = degree_levels(education(p))
    return df.withColumns({
        "organization": organization(p), "posted_at": json_date(_get(p, "$.datePosted")),
        "deadline_at": F.coalesce(json_date(_get(p, "$.validThrough")), deadline(t).cast("timestamp_ntz")),
        "fields_of_study": studies_of(words), "degree_levels": F.when(F.size(taught) > 0, taught).otherwise(levels_of(words)),
        "location": F.coalesce(job_location(p), F.lit("")), "remote": telecommute(p) | remote_of(words),
    }).drop("_posting", "_text", "_named")
