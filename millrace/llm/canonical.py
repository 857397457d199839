"""Mapping of freely typed values to a list of canonical entries (problem 2), in built-in expressions only.

Values and entries are brought to plain forms. Within k edits of an entry cut into k + 1 segments, a form holds one segment
unchanged, at a place that moved by few characters; so an equality join on positional substrings finds every candidate, and the
built-in levenshtein verifies them. What an anti-join finds unmatched is reported with entry -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.pigeonhole import near_pairs
from millrace.session import durable
from millrace.sources.lines import SPACE
from millrace.sources.tables import newest

#: Edits allowed for an entry of at least so many characters.
EDITS = [(6, 2), (5, 1)]
MOST_EDITS = max(k for _, k in EDITS)

# General other names of degree levels, by the plain form of the level; `names` of `map_values` may give others.
DEGREE_NAMES = {
    "secondaryschool": ["high school", "high school diploma", "hs", "grade 12", "school leaver"],
    "certificate": ["cert"],
    "associatedegree": ["associate", "associates", "aa", "as", "aas"],
    "bachelorsdegree": ["bachelor", "bs", "bsc", "ba", "beng", "bba", "undergrad", "undergraduate"],
    "mastersdegree": ["master", "ms", "msc", "ma", "meng", "mba", "mphil", "postgraduate"],
    "doctorate": ["phd", "dphil", "dr", "doctor", "doctoral"],
    "postdoctoral": ["postdoc", "post doctorate"],
    "teachingqualification": ["teacher", "teacher training"],
}
# Words that say nothing of which level is meant, also cut off after three letters or more.
LEVEL_WORDS = ["any", "candidate", "course", "degree", "education", "fellow", "licence", "license", "programme", "program", "qualification", "qualified", "researcher", "short", "taught"]
#: The least letters of a word of a level that stands for the level by itself, or is cut off.
LEAST_WORD, LEAST_CUT = 3, 4
# Words that say nothing of which place is meant.
PLACE_WORDS = ["campus", "the", "office", "near", "greater", "area", "city", "town", "of", "hybrid", "on", "site", "onsite", "remote", "region", "around"]
# What may stand around a field of study.
FIELD_BEFORE = r"^(?:degree|diploma|b\.?sc\.?|b\.?a\.?|m\.?sc\.?|m\.?a\.?|ph\.?d\.?|bachelors?|masters?|major|minor|studies|courses?) (?:in|of) |^(?:school|dept\.?|department|faculty|institute|division|college|chair) (?:of|for) "
FIELD_AFTER = r"(?:,? or (?:similar|related|equivalent).*|,? and related.*| ?/ ?(?:related|similar).*| ?\((?:any track|any|all tracks|major|minor|or similar|related)\))$"
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīłñńňòóôõöøōőřśšťùúûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiilnnnooooooooorsstuuuuuuuyyzzz"


def plain(text: Column) -> Column:
    """Lower case without accents, `&` as a word, white space squeezed."""
    s = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "&", " and "), SPACE + "+", " ")))
    return F.translate(F.regexp_replace(s, r"\p{M}+", ""), ACCENTED, PLAIN)


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def _edits(length: Column) -> Column:
    out = F.lit(0)
    for least, k in sorted(EDITS):
        out = F.when(length >= least, k).otherwise(out)
    return out


def _level_words(words: Column) -> Column:
    """The words that say which level is meant; all of them where none does."""
    cut = "|".join(w if len(w) <= 3 else w[:3] + "".join(f"(?:{c}" for c in w[3:]) + ")?" * (len(w) - 3) for w in LEVEL_WORDS)
    own = F.filter(words, lambda w: ~w.rlike(f"^(?:{cut})s?$"))
    return F.when(F.size(own) > 0, own).otherwise(words)


def _forms(values: DataFrame) -> DataFrame:
    """The plain forms of distinct values: field, value, region, form, preference (the lower the better)."""
    s = plain(F.col("value"))
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(s, r"^\d+[^,;]*[,;]", " "), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(PLACE_WORDS) & ~w.rlike(r"\d"))
    values = values.withColumn("_s", s).withColumn("_w", words)
    code = lambda w: F.length(w) == 2
    many = F.size("_w") > 1
    last, first = F.try_element_at("_w", F.lit(-1)), F.try_element_at("_w", F.lit(1))
    region = F.when(many & code(last), last).when(many & code(first), first)
    town = F.array_join(F.when(many & code(last), F.slice("_w", 1, F.size("_w") - 1)).when(many & code(first), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0)))).otherwise(F.col("_w")), "")
    core = F.regexp_replace(F.regexp_replace(F.col("_s"), FIELD_AFTER, ""), FIELD_BEFORE, "")
    turned = F.regexp_replace(F.regexp_replace(core, r"^(.*), (.*)$", "$2 $1"), r"^(.*?) ?\((.*)\)$", "$2 $1")
    field_forms = F.array(_letters(core), _letters(turned), _letters(F.regexp_replace(core, " studies$", "")))
    every = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.col("_s"), r"['’.]", ""), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    level = _level_words(every)
    alone = lambda i: F.when(F.length(F.try_element_at(level, F.lit(i))) >= LEAST_WORD, F.try_element_at(level, F.lit(i))).otherwise("")
    other = F.array(_letters(F.col("_s")), _letters(F.regexp_replace(F.col("_s"), r"\(.*\)", "")))
    levels = F.concat(other, F.array(F.array_join(level, ""), F.coalesce(alone(1), F.lit("")), F.coalesce(alone(-1), F.lit(""))))
    forms = F.when(F.col("field") == "location", F.array(town)).when(F.col("field") == "fields_of_study", field_forms).when(F.col("field") == "degree_levels", levels).otherwise(other)
    return values.select("field", "value", F.when(F.col("field") == "location", region).alias("region"), F.posexplode(forms).alias("preference", "form")).filter("form <> ''")


def _entries(canon: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """The names by which entries are found: field, canon_id, region, name, fuzzy (whether edits are allowed). A name of two entries is none's."""
    s = plain(F.col("label"))
    canon = canon.select("field", "canon_id", s.alias("_s"), _letters(s).alias("_n"), F.filter(F.split(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "").alias("_w"))
    place = F.col("field") == "location"
    tail = F.nullif(F.regexp_extract("_s", r",\s*([^,]+)$", 1), F.lit(""))
    own = canon.select("field", "canon_id", F.when(place, tail).alias("region"), F.when(place, _letters(F.regexp_replace("_s", r",\s*[^,]+$", ""))).otherwise(F.col("_n")).alias("name"), F.lit(True).alias("fuzzy"))
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*[F.lit(n.replace(" ", "")) for n in v]))]) if names else F.lit(None).cast("map<string,array<string>>")
    no = F.lit(None).cast("string")
    levels = canon.filter(F.col("field") == "degree_levels")
    core = F.array_join(_level_words(F.transform(F.split("_s", " +"), _letters)), "")
    several = F.concat(F.array(core), F.coalesce(known[F.col("_n")], F.array().cast("array<string>")))
    degrees = levels.select("field", "canon_id", no.alias("region"), F.explode(several).alias("name"), F.lit(True).alias("fuzzy"))
    cuts = F.transform(F.sequence(F.lit(LEAST_CUT), F.greatest(F.length(core) - 1, F.lit(LEAST_CUT))), lambda i: F.substring(core, F.lit(1), i))
    degrees = degrees.unionByName(levels.select("field", "canon_id", no.alias("region"), F.explode(cuts).alias("name"), F.lit(False).alias("fuzzy")))
    cut = lambda w: F.substring(w, 1, 4)
    short = canon.filter(F.col("field") == "fields_of_study").select("field", "canon_id", F.explode(F.array(F.col("_w"), F.transform(F.split("_s", " +"), _letters))).alias("w")).filter(F.size("w") > 1)
    w = F.col("w")
    rest, start = F.slice(w, 2, F.size(w) - 1), F.slice(w, 1, F.size(w) - 1)
    names_of = F.array(F.array_join(F.transform(w, cut), ""), F.concat(cut(F.element_at(w, 1)), F.array_join(rest, "")), F.concat(F.array_join(start, ""), cut(F.element_at(w, -1))))
    short = short.select("field", "canon_id", no.alias("region"), F.explode(names_of).alias("name"), F.lit(False).alias("fuzzy"))
    alone = Window.partitionBy("field", "region", "name")
    every = own.unionByName(degrees).unionByName(short).groupBy("field", "canon_id", "region", "name").agg(F.max("fuzzy").alias("fuzzy"))
    every = every.withColumn("_owners", F.count("*").over(alone))
    return every.filter("name <> '' AND (_owners = 1 OR fuzzy)").drop("_owners")


def match_values(values: DataFrame, canon: DataFrame, names: dict[str, list[str]] = DEGREE_NAMES) -> DataFrame:
    """The entry of each distinct value: field, value, canon_id, edits. Values that mean no entry have no row."""
    forms = durable(_forms(values), "forms")
    entries = durable(_entries(canon, names), "entries")
    exact = forms.join(entries.select("field", "name", "canon_id", F.col("region").alias("_r")), (forms["form"] == F.col("name")) & (forms["field"] == entries["field"])).select(
        forms["field"], "value", "form", "region", "_r", "canon_id", "preference", F.lit(0).alias("edits")
    )
    some = entries.filter("fuzzy").select("field", "canon_id", F.col("region").alias("_r"), "name")
    near = near_pairs(forms.filter("field <> 'degree_levels' OR preference < 3"), some, "form", "name", _edits, MOST_EDITS, ["field"]).drop("name")
    found = durable(exact.unionByName(near), "matches")
    # A place with a region is an entry of that region; one without, the only entry of that name.
    regions = entries.filter("region IS NOT NULL").select(F.col("region").alias("_known")).distinct()
    found = found.join(regions, found["region"] == regions["_known"], "left").filter("_known IS NULL OR _r IS NULL OR region = _r")
    best = found.groupBy("field", "value").agg(F.min(F.struct("edits", "preference", "canon_id")).alias("b"), F.min(F.struct("edits", "canon_id")).alias("e"))
    tied = found.filter("field = 'location' AND _known IS NULL").groupBy("field", "value", "edits").agg(F.count_distinct("canon_id").alias("_n")).filter("_n > 1").select("field", "value", F.col("edits").alias("_e"))
    best = best.join(tied, ["field", "value"], "left").filter("_e IS NULL OR _e <> b.edits")
    return best.select("field", "value", "b.canon_id", "b.edits").distinct()


def map_values(occurrences: DataFrame, canon: DataFrame, names: dict[str, list[str]] = DEGREE_NAMES) -> DataFrame:
    """`occurrences` (with the columns field and value) with canon_id, -1 where the value means no entry of its field.

    `canon`: canon_id, field, label. `names`: other names of degree levels by the letters of the level's label. Each distinct value is matched once. Null, empty and blank values have no entry; very long
    ones cost their length; a repeated entry counts once; an equal number of edits falls to the form nearest to what was typed, then
    to the smaller canon_id, but a place of two regions that names none is unmatched. Other columns of `occurrences` stay unless
    named canon_id; an empty table gives an empty table.
    """
    occurrences = durable(occurrences.drop("canon_id"), "occurrences")
    values = durable(occurrences.select("field", "value").filter(F.col("value").isNotNull() & (F.regexp_replace("value", SPACE + "+", "") != "")).distinct(), "values")
    entries = canon.select("field", F.col("canon_id").cast("bigint").alias("canon_id"), "label").filter("canon_id IS NOT NULL AND label IS NOT NULL").distinct()
    matched = durable(match_values(values, entries, names).select("field", "value", "canon_id"), "matched")
    unmatched = values.join(matched, ["field", "value"], "left_anti").withColumn("canon_id", F.lit(-1).cast("bigint"))
    keys = matched.unionByName(unmatched)
    out = occurrences.join(keys, ["field", "value"], "left")
    return out.withColumn("canon_id", F.coalesce("canon_id", F.lit(-1).cast("bigint")))


def page_values(pages: DataFrame) -> DataFrame:
    """The values of location, degree_levels and fields_of_study of each page's newest crawl that are neither null nor blank: page_id, field, value_pos, value."""
    one = newest(pages, "page_id", "last_crawled_at", ["location", "degree_levels", "fields_of_study"])
    place = lambda name, a: F.transform(a, lambda v, i: F.struct(F.lit(name).alias("field"), (i + 1).alias("value_pos"), v.alias("value")))
    parts = [place("location", F.array("location")), *[F.coalesce(place(c, F.col(c)), F.array().cast("array<struct<field:string,value_pos:int,value:string>>")) for c in ("degree_levels", "fields_of_study")]]
    return one.select("page_id", F.explode(F.concat(*parts)).alias("x")).select("page_id", "x.*").filter(F.regexp_replace("value", SPACE + "+", "") != "")
