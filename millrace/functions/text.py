"""Splitting, cleaning and stemming of words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.language import language_of
from millrace.functions.stemming import STEMMERS, stem_english
from millrace.sources.lines import SPACE

#: The least confidence with which a language other than English is taken.
SURE = 0.6

# The letters beyond a-z, A-Z and 0-9 that each language keeps.
LETTERS = {
    "english": "",
    "spanish": "áéíóúÁÉÍÓÚñÑüÜ",
    "german": "äöüÄÖÜß",
    "russian": "а-яА-Я",
    "arabic": "ء-ي",
    "chinese": "\u4e00-\u9fa5",
    "japanese": "\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fa5",
    "korean": "\uac00-\ud7af\u1100-\u11ff\u3130-\u318f",
    "thai": "ก-๙",
    "persian": "آ-ی",
    "indonesian": "",
    "malay": "",
    "filipino": "",
    "portuguese": "áàãâéêíóôõúçÁÀÃÂÉÊÍÓÔÕÚÇ",
    "french": "àâçéèêëîïôûùüÿñæœÀÂÇÉÈÊËÎÏÔÛÙÜŸÑÆŒ",
    "italian": "àèéìíîòóùú",
    "dutch": "",
    "polish": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "ukrainian": "а-яА-ЯіїєґІЇЄҐ",
    "romanian": "ăâîșțĂÂÎȘȚ",
    "greek": "α-ωΑ-ΩάέήίϊΐόύϋΰώΆΈΉΊΌΎΏ",
    "hungarian": "áéíóöőúüűÁÉÍÓÖŐÚÜŰ",
    "finnish": "äöåÄÖÅ",
    "swedish": "åäöÅÄÖ",
    "norwegian": "æøåÆØÅ",
    "danish": "æøåÆØÅ",
    "icelandic": "áðéíóúýþæöÁÐÉÍÓÚÝÞÆÖ",
    "czech": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ",
    "slovak": "áäčďéíĺľňóôŕšťúýžÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ",
    "croatian": "čćdžđšžČĆDŽĐŠŽ",
    "bosnian": "čćdžđšžČĆDŽĐŠŽ",
    "albanian": "ëçëÇ",
    "estonian": "äöõüšžÄÖÕÜŠŽ",
    "latvian": "āčēģīķļņšūžĀČĒĢĪĶĻŅŠŪŽ",
    "lithuanian": "ąčęėįšųūžĄČĘĖĮŠŲŪŽ",
    "georgian": "ა-ჰ",
}
LANGUAGE_OF_CODE = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "pl": "polish", "sv": "swedish", "da": "danish", "fi": "finnish", "ru": "russian", "ja": "japanese"}


def fields(text: Column) -> Column:
    """The words between white space, none of them empty."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|(?<!{SPACE}){SPACE}++$", "")  # linear in runs of white space too


def pattern_of(language: str) -> str:
    """The pattern of the characters that a language drops; an unknown one drops all but ASCII letters and digits."""
    return f"[^a-zA-Z0-9{LETTERS.get(language.lower(), '')}]+"


def sanitised(words: Column, language: str = "english") -> Column:
    """Words without the characters their language drops, in lower case; what is left empty is dropped."""
    return F.filter(F.transform(words, lambda w: F.lower(F.regexp_replace(w, pattern_of(language), ""))), lambda w: w != "")


def without(words: Column, stop: list[str] | None) -> Column:
    """Words that are not in the stop list; None, as by default, drops none. Repeated words stay."""
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


# The code points of white space of every kind, as in SPACE.
_WHITE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(characters: str) -> list[tuple[int, int]]:
    """The code points of characters and of ranges `a-b`."""
    out, i = [], 0
    while i < len(characters):
        wide = characters[i + 1 : i + 2] == "-" and i + 2 < len(characters)
        out.append((ord(characters[i]), ord(characters[i + 2 if wide else i])))
        i += 3 if wide else 1
    return out


@lru_cache(maxsize=64)
def _others(language: str) -> str:
    """The class of all characters that a language drops, white space not among them.

    It lists them: the regular expressions of Java take ten times as long for a class that is the negation of another.
    """
    out, at = "", 0
    for a, b in sorted(_ranges("a-zA-Z0-9" + LETTERS.get(language.lower(), "") + _WHITE)):
        if a > at:
            out += f"\\x{{{at:x}}}-\\x{{{a - 1:x}}}"
        at = max(at, b + 1)
    return f"[{out}\\x{{{at:x}}}-\\x{{10ffff}}]"


def kept(text: Column, language: str = "english") -> Column:
    """A text in lower case without the characters its language drops; white space stays, so one expression serves all words."""
    return F.lower(F.regexp_replace(text, _others(language) + "+", ""))


def tokens(text: Column, language: str = "english", stop: list[str] | None = None) -> Column:
    """The tokens of a text before stemming."""
    return without(fields(kept(text, language)), stop)


def tokens_by(text: Column, language: Column) -> Column:
    """The same with the language of a column; an unknown one drops all but ASCII letters and digits."""
    names = [n for n, letters in LETTERS.items() if letters]
    low = F.lower(language)
    out = F.when(low == names[0], kept(text, names[0]))
    for n in names[1:]:
        out = out.when(low == n, kept(text, n))
    return fields(out.otherwise(kept(text)))


def byte_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """The edit distance of the lower-cased texts' UTF-8 bytes; -1 beyond `most`."""
    raw = lambda c: F.decode(F.encode(F.lower(c), "UTF-8"), "ISO-8859-1")
    return F.levenshtein(raw(a), raw(b)) if most is None else F.levenshtein(raw(a), raw(b), most)


def byte_prefix(text: Column, size: int) -> Column:
    """The first bytes of a text, as valid text."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string"))


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    """English stems. Meant for a column of distinct words, joined back afterwards."""
    return words.map(stem_english, na_action="ignore")


@F.pandas_udf(T.StringType())
def stem_by(frame: pd.DataFrame) -> pd.Series:
    """Stems of (word, language); a word of a language without a stemmer stays as it is."""
    return pd.Series([None if w is None else STEMMERS[k](w) if k in STEMMERS else w for w, k in zip(frame.iloc[:, 0], frame.iloc[:, 1])], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """English stems of arrays, each distinct word of a batch stemmed once."""
    known: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [known[w] if w in known else known.setdefault(w, stem_english(w)) for w in ws])


@F.pandas_udf(T.StringType())
def detected(texts: pd.Series) -> pd.Series:
    """The language of each text; English where the confidence is below 0.6."""

    def one(t: str | None) -> str:
        language, sure = language_of(t)
        return language if sure >= SURE else "english"

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def index_tokens(frame: pd.DataFrame) -> pd.Series:
    """Tokens of (text, language): cleaned and stemmed by the language; words of a language without a stemmer stay as they are."""
    known: dict[str, dict[str, str]] = {}
    out = []
    for text, language in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
        language = language or "english"
        words = _dropped(language).sub("", text or "").lower().split()
        if language in STEMMERS:
            of, make = known.setdefault(language, {}), STEMMERS[language]
            words = [of[w] if w in of else of.setdefault(w, make(w)) for w in words]
        out.append(words)
    return pd.Series(out)


@lru_cache(maxsize=64)
def _dropped(language: str) -> re.Pattern:
    return re.compile(rf"[^a-zA-Z0-9{LETTERS.get(language.lower(), '')}\s\x1c-\x1f\x85]+")
