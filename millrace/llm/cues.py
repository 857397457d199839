"""Cues by which training lines are labelled, and small word lists of the languages read.

Everything here is general wording of web pages and of texts: it labels the bounded samples that models are trained on.
"""

from __future__ import annotations

import re

# Function words of the languages read.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at for from with by as is are was were be been will would can may must not no this that these those it its they them their you your we our he she his her who which what when where if then than so because since although before after while also more most some any each every there here how do does did have has had about into over under between during until".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber von zu zum zur in im ins an am auf für mit bei nach aus als ist sind war waren wird werden kann können muss nicht kein keine dieser diese dieses es sie er wir ihr ihre ihren uns unser sein seine wer was wann wo wenn dann weil obwohl bevor während auch mehr jede jeder jedes wie hat haben über unter zwischen bis um sich".split(),
    "fr": "le la les un une des du de d l et ou mais à au aux en dans sur pour par avec sans sous chez est sont était être sera peut doit ne pas ce cet cette ces il elle ils elles nous vous on se son sa ses leur leurs notre nos votre vos qui que quoi quand où si alors car parce comme afin puis aussi plus chaque tout tous dès jusqu entre pendant avant après qu s n c j".split(),
    "es": "el la los las un una unos unas y o pero de del a al en con por para sin sobre entre desde hasta es son era ser será puede debe no este esta estos estas ese esa lo le les nos se su sus nuestro nuestra quien que cuando donde si porque como también más cada todo todos muy hay".split(),
}
ALL_FUNCTION_WORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)

# General wordings of notices, menus and controls of web pages, which mark a training line as outside the main text.
OUTSIDE = [
    r"\bcookies?\b|\btracking pixels\b|\bsimilar technologies\b|\bstrictly necessary\b|\bprivacy (?:settings|notice|policy)\b|\baccept all\b|\breject non-essential\b|\bmanage (?:your )?(?:choices|preferences)\b|\bby continuing you agree\b|\bchoose what you allow\b|\bgot it\b|^\d+ vendors\b",
    r"^(?:jump|skip) to\b|^zum inhalt\b|^aller au contenu\b|^(?:home|menu|search|contact|about|impressum|datenschutz|sign in|log ?in|register)$|^you are here\b|\bback to top\b",
    r"©|^copyright\b|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|^terms of use\b|\btrademarks?\b|\bwithout (?:written|prior) consent\b",
    r"\bnewsletter\b|^subscribe\b|\bsign up for\b|^log in or\b|^already registered\b|^forgot password\b|\babonnieren\b",
    r"^(?:related|recently viewed|you may also like|more from|popular|à lire aussi|das könnte sie auch)\b|^advertisement\b",
    r"^(?:share|teilen|partager)\b.*(?:\||:|\bon\b)|^(?:like|share|tweet) this\b|^\d+ shares\b|[♥↻✉]",
    r"^(?:posted by|written by|last updated|filed under)\b|^by [^.]+$",
    r"^page \d+ of \d+|^previous\b.*\bnext\b|^showing \d+ of|^load more\b",
    r"\baccepts no liability\b|\bis not responsible for\b|\bequal opportunity\b|\bwithout warranty\b",
]
OUTSIDE_RE = re.compile("|".join(f"(?:{p})" for p in OUTSIDE))
_SEPARATOR_RE = re.compile(r"[|>»/·•\t]")
_DASHES_RE = re.compile(r" [-–—] ")
_SPOKEN_RE = re.compile(r"(?:you|we|our|they|the (?:team|group|course|post)) (?:will|have|are|can|also|often)\b")
_STOPS_RE = re.compile(r"[.!?…][\"'”»)]* \S")  # a sentence alone may as well be a notice
INSIDE_RE = re.compile(
    r"^[•*–-] |^(?:start|stipend|salary|pay|key facts|deadline|location|duration|hours|fee)\b ?[:,]|^(?:timetable|eligibility|requirements|how to|what you will do|about)\b .{6,}"
)


def squeezed(line: str) -> str:
    """Lower case, white space squeezed."""
    return " ".join(line.lower().split())


def is_prose(s: str) -> bool:
    """Whether a squeezed line holds at least one whole sentence of some length with function words."""
    words = re.findall(r"[^\W\d_]+", s)
    return len(words) >= 8 and sum(w in ALL_FUNCTION_WORDS for w in words) >= max(2, len(words) * 0.12) and s.rstrip("\"'”»)")[-1:] in ".!?…"


def is_menu(line: str) -> bool:
    """Whether a line is entries of some length between separators, or three at least between dashes."""
    parts = _SEPARATOR_RE.split(line.strip())
    if not parts[-1]:
        parts.pop()
    if len(parts) < 2:
        parts = _DASHES_RE.split(parts[0]) if parts else []
        if len(parts) < 3:
            return False
    return len(parts) > 1 and all(len(p) > 1 and len(p.strip()) <= 40 for p in parts)


def label(line: str, recurs: bool = False) -> bool | None:
    """Whether a training line is of the main text: not if it recurs on its site, else judged by general cues; None where none applies."""
    s = squeezed(line)
    if not s:
        return None
    if recurs:
        return False
    if _SPOKEN_RE.match(s) and is_prose(s):
        return True
    if OUTSIDE_RE.search(s):
        return False
    if is_menu(line):
        return False
    if INSIDE_RE.search(s) or (is_prose(s) and _STOPS_RE.search(s)):
        return True
    return None
