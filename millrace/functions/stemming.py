"""Stemmers from their published definitions: English (Porter2), German, French and Spanish (Snowball).

Each works on the regions R1, R2 and RV that the definitions give. Meant for distinct words: the caller remembers what it has stemmed.
"""

from __future__ import annotations

from collections.abc import Callable

# English

# Exceptions and endings of the published English stemmer.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_VOWELS = set("aeiouy")


def _after(w: str, vowels: set[str], i: int = 0) -> int:
    """The place after the first consonant that follows a vowel, from i on."""
    while i < len(w) and w[i] not in vowels:
        i += 1
    while i < len(w) and w[i] in vowels:
        i += 1
    return min(i + 1, len(w))


def _longest(w: str, endings: list[str] | tuple[str, ...]) -> str | None:
    """The longest of the endings that a word has."""
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _ends_short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem_english(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    w = word[1:] if word.startswith("'") else word
    if len(w) <= 2:
        return word
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _SAME:
        return w
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = start if start is not None else _after(w, _VOWELS)
    r2 = _after(w, _VOWELS, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if w.endswith(("eedly", "eed")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(c in _VOWELS for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _ends_short(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in set("cdeghkmnrt")):
                w = w[: -len(end)] + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# German

_DE_VOWELS = set("aeiouyäöü")


def stem_german(word: str) -> str:
    """The German Snowball stem of a lower-case word."""
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in _DE_VOWELS and w[i + 1] in _DE_VOWELS else c for i, c in enumerate(w))
    first = _after(w, _DE_VOWELS)
    r1, r2 = max(first, 3), _after(w, _DE_VOWELS, first)
    fits = lambda end, region: end is not None and len(w) - len(end) >= region
    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and (end != "s" or w[-2:-1] in set("bdfghklmnrt")) and fits(end, r1):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"))
    if fits(end, r1) and (end != "st" or (w[-3:-2] in set("bdfghklmnt") and len(w) >= 6)):
        w = w[: -len(end)]
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if fits(end, r2):
        if end in ("end", "ung"):
            w = w[: -len(end)]
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            if w[-len(end) - 1 : -len(end)] != "e":
                w = w[: -len(end)]
        elif end in ("lich", "heit"):
            w = w[: -len(end)]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[: -len(end)]
            more = _longest(w, ("lich", "ig"))
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


# French

_FR_VOWELS = set("aeiouyâàëéêèïîôûù")
# Endings of verbs of the published French stemmer.
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_FR_STANDARD = (
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses amment emment ment ments".split()
)


def stem_french(word: str) -> str:
    """The French Snowball stem of a lower-case word."""
    v = _FR_VOWELS
    w = ""
    for i, c in enumerate(word):
        before, then = word[i - 1 : i] if i else "", word[i + 1 : i + 2]
        if (c in "ui" and before in v and then in v and before and then) or (c == "y" and ((before and before in v) or (then and then in v))) or (c == "u" and before == "q"):
            c = c.upper()
        w += c
    if len(w) > 1 and w[0] in v and w[1] in v:
        rv = 3
    elif w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i, c in enumerate(w) if i > 0 and c in v), len(w))
    rv = min(rv, len(w))
    r1 = _after(w, v)
    r2 = _after(w, v, r1)
    within = lambda end, region: len(w) - len(end) >= region
    start, verb = w, False
    end = _longest(w, _FR_STANDARD)
    done = False
    if end:
        stem = w[: -len(end)]
        if end in ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"):
            if within(end, r2):
                w, done = stem, True
        elif end in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
            if within(end, r2):
                w, done = stem, True
                if w.endswith("ic"):
                    w = w[:-2] if within("ic", r2) else w[:-2] + "iqU"
        elif end in ("logie", "logies"):
            if within(end, r2):
                w, done = stem + "log", True
        elif end in ("usion", "ution", "usions", "utions"):
            if within(end, r2):
                w, done = stem + "u", True
        elif end in ("ence", "ences"):
            if within(end, r2):
                w, done = stem + "ent", True
        elif end in ("ement", "ements"):
            if within(end, rv):
                w, done = stem, True
                if w.endswith("iv") and within("iv", r2):
                    w = w[:-2]
                    if w.endswith("at") and within("at", r2):
                        w = w[:-2]
                elif w.endswith("eus"):
                    if within("eus", r2):
                        w = w[:-3]
                    elif within("eus", r1):
                        w = w[:-1] + "x"
                elif w.endswith(("abl", "iqU")):
                    if within("abl", r2):
                        w = w[:-3]
                elif w.endswith(("ièr", "Ièr")) and within("ièr", rv):
                    w = w[:-3] + "i"
        elif end in ("ité", "ités"):
            if within(end, r2):
                w, done = stem, True
                if w.endswith("abil"):
                    w = w[:-4] if within("abil", r2) else w[:-4] + "abl"
                elif w.endswith("ic"):
                    w = w[:-2] if within("ic", r2) else w[:-2] + "iqU"
                elif w.endswith("iv") and within("iv", r2):
                    w = w[:-2]
        elif end in ("if", "ive", "ifs", "ives"):
            if within(end, r2):
                w, done = stem, True
                if w.endswith("at") and within("at", r2):
                    w = w[:-2]
                    if w.endswith("ic"):
                        w = w[:-2] if within("ic", r2) else w[:-2] + "iqU"
        elif end == "eaux":
            w, done = stem + "eau", True
        elif end == "aux":
            if within(end, r1):
                w, done = stem + "al", True
        elif end in ("euse", "euses"):
            if within(end, r2):
                w, done = stem, True
            elif within(end, r1):
                w, done = stem + "eux", True
        elif end in ("amment", "emment"):
            if within(end, rv):
                w, verb = stem + ("ant" if end[0] == "a" else "ent"), True
        elif within(end, rv) and len(stem) > rv - 1 and stem[-1:] in v and len(stem) - 1 >= rv:  # ment, ments after a vowel in RV
            w, verb = stem, True
    if not done or verb:
        region = w[rv:]
        end = _longest(region, _FR_I)
        if not done and not verb or verb:
            if end and len(region) > len(end) and region[-len(end) - 1] not in v:
                w, done = w[: -len(end)], True
            else:
                end = _longest(region, [*_FR_E, *_FR_A, "ions"])
                if end == "ions":
                    if within("ions", r2):
                        w, done = w[:-4], True
                elif end in _FR_E:
                    w, done = w[: -len(end)], True
                elif end:
                    w, done = w[: -len(end)], True
                    if w[rv:].endswith("e"):
                        w = w[:-1]
    if w != start:
        w = w[:-1] + ("i" if w[-1:] == "Y" else "c" if w[-1:] == "ç" else w[-1:])
    elif not done:
        if len(w) > 1 and w[-1] == "s" and w[-2] not in "aiouès":
            w = w[:-1]
        region = w[rv:]
        end = _longest(region, ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if end == "ion":
            if within("ion", r2) and region[:-3][-1:] in ("s", "t"):
                w = w[:-3]
        elif end == "e":
            w = w[:-1]
        elif end:
            w = w[: -len(end)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    k = len(w)
    while k and w[k - 1] not in v:
        k -= 1
    if 0 < k < len(w) and w[k - 1] in "éè":
        w = w[: k - 1] + "e" + w[k:]
    return w.lower()


# Spanish

_ES_VOWELS = set("aeiouáéíóúü")
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
# Endings of the published Spanish stemmer.
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_STANDARD = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split()
)
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
)


def stem_spanish(word: str) -> str:
    """The Spanish Snowball stem of a lower-case word."""
    v, w = _ES_VOWELS, word
    if len(w) > 1 and w[1] not in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    elif len(w) > 1 and w[0] in v and w[1] in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    else:
        rv = min(3, len(w))
    r1 = _after(w, v)
    r2 = _after(w, v, r1)
    within = lambda end, region: len(w) - len(end) >= region
    pronoun = _longest(w, _ES_PRONOUNS)
    if pronoun and within(pronoun, rv):
        stem = w[: -len(pronoun)]
        before = _longest(stem[rv:], ("iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir", "yendo"))
        if before in ("iéndo", "ándo", "ár", "ér", "ír"):
            w = stem[: -len(before)] + before.translate(_ES_PLAIN)
        elif before and (before != "yendo" or stem[: -len(before)].endswith("u")):
            w = stem
    start = w
    end = _longest(w, _ES_STANDARD)
    if end == "amente":
        if within(end, r1):
            w = w[:-6]
            more = _longest(w, ("iv", "os", "ic", "ad"))
            if more and within(more, r2):
                w = w[:-2]
                if more == "iv" and w.endswith("at") and within("at", r2):
                    w = w[:-2]
    elif end and within(end, r2):
        w = w[: -len(end)]
        if end in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
            if w.endswith("ic") and within("ic", r2):
                w = w[:-2]
        elif end in ("logía", "logías"):
            w += "log"
        elif end in ("ución", "uciones"):
            w += "u"
        elif end in ("encia", "encias"):
            w += "ente"
        elif end == "mente":
            more = _longest(w, ("ante", "able", "ible"))
            if more and within(more, r2):
                w = w[: -len(more)]
        elif end in ("idad", "idades"):
            more = _longest(w, ("abil", "ic", "iv"))
            if more and within(more, r2):
                w = w[: -len(more)]
        elif end in ("iva", "ivo", "ivas", "ivos") and w.endswith("at") and within("at", r2):
            w = w[:-2]
    if w == start:
        end = _longest(w[rv:], _ES_Y)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _longest(w[rv:], [*_ES_VERB, "en", "es", "éis", "emos"])
            if end:
                w = w[: -len(end)]
                if end in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    end = _longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ES_PLAIN)


STEMMERS: dict[str, Callable[[str], str]] = {"english": stem_english, "german": stem_german, "french": stem_french, "spanish": stem_spanish}
