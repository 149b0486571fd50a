"""Spans of legal texts: references, citations of laws, and the values in a text with what they stand in.

Offsets count code points from 0; ends are exclusive. Everything is read once from left to right but for years, which
are told backwards from their dash. Only the digits 0 to 9 count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

# Nouns that take a label, units that make a number a quantity, words that open a law's name, the letters
# that may stand before a noun, and the kinds of values, first ones prevail.
NOUNS = ("סעיף", "סעיפים", "פסקה", "פסקאות", "תקנה", "תקנות", "פרט", "פרטים", "פריט", "פריטים", "תוספת", "תוספות", "חלק", "חלקים", "פרק", "פרקים", "סימן", "סימנים")
SECOND_WORDS = {"סעיף": "קטן", "סעיפים": "קטנים", "פסקת": "משנה", "פסקאות": "משנה"}
MEASURES = ("ימים", "יום", "ימי", "שנים", "שנה", "חודשים", "חודש", "שבועות", "שבוע", "שעות", "שעה", "דקות", "שקלים", 'ש"ח', "אחוזים", "אחוז", "%")
OPENINGS = ("חוק", "פקודת", "פקודה", "חוק-יסוד", "תקנות", "צו")
PREFIXES = "ובלמכשה"
KINDS = ("hebrew_year", "section_ref", "gregorian_year", "number")
REACH = 80

LETTERS = "אבגדהוזחטיךכלםמןנסעףפץצקרשת"
_RUN = re.compile(r"(?<![\w֐-׿])([0-9]+)[\w֐-׿]*")  # only runs that begin with a digit hold values
_DASH = re.compile(r"[-–](?=(\s*[0-9]{4}))")
_LETTER = re.compile(r"\w")
_YEARS = {second: re.compile(f"ה?ת[{second}][{LETTERS}\"״׳']{{0,4}}\\Z") for second in (LETTERS, "קרש")}
_WORD = re.compile(f"[{LETTERS}]+")
_DIGITS = re.compile("[0-9]+")
_BRACKETED = re.compile(r"(?:\([^()\s]{1,4}\))+")
_NUMBERED = re.compile(rf"[0-9]{{1,4}}[{LETTERS}]{{0,3}}[0-9]?")
_LABELLED = re.compile(rf"[0-9]{{1,3}}[{LETTERS}]{{1,3}}[0-9]?")
_BLANKS = re.compile(r"\s*")


class Anchor(NamedTuple):
    start: int
    end: int
    text: str
    kind: str
    in_reference: bool
    in_citation: bool


def _after_blanks(text: str, at: int) -> int:
    return _BLANKS.match(text, at).end()


def _before_blanks(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _label(text: str, at: int) -> int | None:
    """The end of the label that begins at a place: a number or brackets, with or without quotation marks."""
    start = at + (text[at : at + 1] in ('"', "״") and at < len(text))
    body = _NUMBERED.match(text, start)
    end = body.end() if body else start
    brackets = _BRACKETED.match(text, end)
    end = brackets.end() if brackets else end
    if end == start:
        return None
    return end + (end < len(text) and text[end] in '"״')


def _next_label(text: str, at: int) -> int | None:
    """The end of the next label of a list: a comma, a dash or a word between, no measure and no letter behind it."""
    i = _after_blanks(text, at)
    if text[i : i + 1] in (",", "-", "–") and i < len(text):
        i = _after_blanks(text, i + 1)
    elif i > at and text[i : i + 1] == "ו":
        i += 2 if text[i + 1 : i + 2] == "-" else 1
    elif i > at and text.startswith(("או", "עד"), i) and text[i + 2 : i + 3].isspace():
        i = _after_blanks(text, i + 2)
    else:
        return None
    end = _label(text, i)
    if end is None or text[end : end + 1].isdecimal() or _WORD.match(text, end) or text.startswith(MEASURES, _after_blanks(text, end)):
        return None
    return end


@lru_cache(1 << 16)
def _nouns(word: str) -> tuple[str, ...]:
    """The nouns of reference that a word is, behind up to three letters that may stand before a noun."""
    found = []
    for skip in range(4):
        if skip and (skip > len(word) or word[skip - 1] not in PREFIXES):
            break
        if word[skip:] in NOUNS or word[skip:] in SECOND_WORDS:
            found.append(word[skip:])
    return tuple(found)


def references(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a noun of reference with its label or list of labels."""
    done = 0
    for m in _WORD.finditer(text):
        if m.start() < done:
            continue
        for noun in _nouns(m[0]):
            at = m.end()
            second = SECOND_WORDS.get(noun)
            follower = _WORD.match(text, _after_blanks(text, at)) if second else None
            if follower and follower[0] == second and follower.start() > at:
                at = follower.end()
            elif noun not in NOUNS:
                continue
            start = _after_blanks(text, at)
            end = _label(text, start) if start > at else None
            if end is None:
                continue
            while (more := _next_label(text, end)) is not None:
                end = more
            yield m.start(), end
            done = end
            break


def _dashes_before_years(text: str) -> Iterator[tuple[int, int]]:
    """(end of what stands before the dash, end of the four digits) for each dash with a year behind it."""
    for m in _DASH.finditer(text):
        yield _before_blanks(text, m.start()), m.end(1)


def _year_before(text: str, end: int, second: str) -> int | None:
    """The start of the year in letters that ends at a place, the longest one."""
    m = _YEARS[second].search(text, max(0, end - 7), end)
    return m.start() if m else None


def citations(text: str, dashes: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Spans of laws that are cited by name and year, merged where they overlap: back from each year over a comma and a
    bracket to the first opening word within reach."""
    out: list[tuple[int, int]] = []
    for before, end in _dashes_before_years(text) if dashes is None else dashes:
        year = _year_before(text, before, LETTERS)
        if year is None:
            continue
        at = _before_blanks(text, year)
        at = _before_blanks(text, at - 1) if at and text[at - 1] == "," else at
        if at and text[at - 1] == ")":
            opens = text.rfind("(", max(0, at - REACH - 2), at - 1)
            if opens >= 0 and ")" not in text[opens : at - 1]:
                at = opens
        low = max([text.rfind(c, 0, at) + 1 for c in ",()"])
        starts = [i for word in OPENINGS for i in _places(text, word, max(low, at - REACH - len(word)), at)]
        if starts:
            start = min(starts)
            while out and out[-1][1] > start:
                start = min(start, out.pop()[0])
            out.append((start, end))
    return out


def _places(text: str, word: str, low: int, high: int) -> Iterator[int]:
    at = text.find(word, low, high)
    while at >= 0:
        yield at
        at = text.find(word, at + 1, high)


def _values(text: str, dashes: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of all values."""
    done = 0
    for before, _ in dashes:
        start = _year_before(text, before, "קרש")
        if start is not None and start >= done:
            yield start, before, 0
            done = before
    for m in _RUN.finditer(text):
        if _LABELLED.fullmatch(m[0]):
            yield m.start(), m.end(), 1
        if len(m[1]) <= 4 and not _LETTER.match(text, m.end(1)):
            yield m.start(), m.end(1), 3
    for m in _DIGITS.finditer(text):
        if len(m[0]) == 4 and m[0][:2] in ("18", "19", "20"):
            yield m.start(), m.end(), 2


def _inside(spans: list[tuple[int, int]], places: list[tuple[int, int]]) -> list[bool]:
    """Whether each place, by start, lies in one of the spans, which are apart and in order: one sweep over both."""
    out, i = [], 0
    for start, end in places:
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        out.append(i < len(spans) and spans[i][0] <= start and end <= spans[i][1])
    return out


def anchors(text: str) -> list[Anchor]:
    """All values by place; of equal spans the first kind stays. Labels are references by their form."""
    best: dict[tuple[int, int], int] = {}
    dashes = list(_dashes_before_years(text))
    for start, end, kind in _values(text, dashes):
        best[start, end] = min(kind, best.get((start, end), kind))
    found = sorted((start, kind, end) for (start, end), kind in best.items())
    places = [(start, end) for start, _, end in found]
    referred, cited = _inside(list(references(text)), places), _inside(citations(text, dashes), places)
    return [Anchor(s, e, text[s:e], KINDS[k], k == 1 or r, c) for (s, k, e), r, c in zip(found, referred, cited)]
