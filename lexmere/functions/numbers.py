"""Numbers in Hebrew words and back, and quantities (a number with a unit) in texts, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of numbers, masculine and feminine, and the forms of units (one, several, two, feminine or not).
ONES = {False: ["", "אחד", "שניים", "שלושה", "ארבעה", "חמישה", "שישה", "שבעה", "שמונה", "תשעה"], True: ["", "אחת", "שתיים", "שלוש", "ארבע", "חמש", "שש", "שבע", "שמונה", "תשע"]}
TEEN_ONES = {False: ["", "אחד", "שנים", *ONES[False][3:]], True: ["", "אחת", "שתים", *ONES[True][3:]]}
TEN = {False: "עשרה", True: "עשר"}  # behind a teen's ones it is the other one
TENS = ["", "", "עשרים", "שלושים", "ארבעים", "חמישים", "שישים", "שבעים", "שמונים", "תשעים"]
HUNDREDS = ["", "מאה", "מאתיים", *[f"{x} מאות" for x in ONES[True][3:]]]
COUNTED = ["שלושת", "ארבעת", "חמשת", "ששת", "שבעת", "שמונת", "תשעת", "עשרת"]
THOUSANDS = ["", "אלף", "אלפיים", *[f"{x} אלפים" for x in COUNTED]]
UNITS = {
    "ימים": ("יום", "יומיים", False),
    "חודשים": ("חודש", "חודשיים", False),
    "שבועות": ("שבוע", "שבועיים", False),
    "שנים": ("שנה", "שנתיים", True),
    "שעות": ("שעה", "שעתיים", True),
    "דקות": ("דקה", "", True),
    "שקלים": ("שקל", "", False),
    "אחוזים": ("אחוז", "", False),
}
HUNDRED_WORD, THOUSAND_WORD, THOUSANDS_WORD = "מאות", "אלף", "אלפים"

#: What each word adds; hundreds and thousands multiply what stands before them.
VALUES = (
    {w: k for words in (*ONES.values(), *TEEN_ONES.values(), TENS) for k, w in enumerate(words) if w}
    | {w: 10 * k for k, w in enumerate(TENS) if w}
    | {"שני": 2, "שתי": 2, TEN[False]: 10, TEN[True]: 10, "מאה": 100, "מאתיים": 200}
    | {w: k for k, w in enumerate(COUNTED, 3)}
)
MULTIPLIED = {HUNDRED_WORD: -1, THOUSAND_WORD: -2, THOUSANDS_WORD: -2, "אלפיים": -3}
UNIT_OF = {form: several for several, (one, two, _) in UNITS.items() for form in (one, several, two) if form}


def _pick(words: list[str], at: Column) -> Column:
    return F.get(F.lit(words), at.cast("int"))


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _with_and(first: str, last: str) -> str:
    """Two parts of a number: the last one gets an and, unless one of its own parts has it."""
    return first + (" " if " ו" in last else " ו") + last if first and last else first or last


def _below_thousand(n: int, feminine: bool) -> str:
    rest, ones = n % 100, n % 10
    if rest < 10:
        low = ONES[feminine][rest]
    elif rest < 20:
        low = f"{TEEN_ONES[feminine][ones]} {TEN[not feminine]}" if ones else TEN[feminine]
    else:
        low = TENS[rest // 10] + (f" ו{ONES[feminine][ones]}" if ones else "")
    return _with_and(HUNDREDS[n // 100], low)


#: By these rules, the words below a thousand and those of thousands.
LOW = {feminine: [_below_thousand(n, feminine) for n in range(1000)] for feminine in (False, True)}
HIGH = THOUSANDS + [f"{LOW[False][n]} {THOUSAND_WORD}" for n in range(len(THOUSANDS), 100)]


def number_words(n: Column, feminine: Column) -> Column:
    """A number from 1 to 99,999 in words; null for others."""
    rest = F.pmod(n, F.lit(1000))
    first, last = _pick(HIGH, F.floor(n / 1000)), F.when(feminine, _pick(LOW[True], rest)).otherwise(_pick(LOW[False], rest))
    glue = F.when((n < 1000) | (rest == 0), "").when(F.contains(last, F.lit(" ו")), " ").otherwise(" ו")
    return F.when((n > 0) & (n < 100_000), F.concat(first, glue, last))


def quantity(n: Column, several: Column) -> Column:
    """A number with a unit, named by its plural: the unit alone for one, its dual for two if it has one; null for an unknown unit."""
    form = lambda k: F.element_at(_table({u: f[k] for u, f in UNITS.items()}), several)
    two = F.when(form(1) != "", form(1)).otherwise(F.concat(F.when(form(2), "שתי ").otherwise("שני "), several))
    return F.when(form(0).isNotNull(), F.when(n == 1, form(0)).when(n == 2, two).otherwise(F.concat(number_words(n, form(2)), F.lit(" "), several)))


def parsed_number(text: Column) -> Column:
    """The number that words spell, each with or without an and in front; null if a word is none of a number's."""
    values = _table(VALUES | MULTIPLIED)
    value = lambda w: F.coalesce(F.element_at(values, w), F.when(w.startswith("ו"), F.element_at(values, F.substr(w, F.lit(2)))))
    words = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), value)
    state = lambda total, now: F.struct(total.cast("long").alias("total"), now.cast("long").alias("now"))
    zero = F.lit(0)

    def step(s: Column, v: Column) -> Column:
        ones = F.pmod(s["now"], F.lit(10))
        return (
            F.when(v == -1, state(s["total"], s["now"] - ones + ones * 100))
            .when(v == -2, state(s["total"] + F.greatest(s["now"], F.lit(1)) * 1000, zero))
            .when(v == -3, state(s["total"] + 2000, zero))
            .otherwise(state(s["total"], s["now"] + v))
        )

    n = F.aggregate(words, state(zero, zero), step, lambda s: s["total"] + s["now"])
    return F.when((F.size(words) > 0) & ~F.exists(words, lambda v: v.isNull()), F.nullif(n, F.lit(0)))


def quantities(text: Column) -> Column:
    """array<struct<text, value, unit, digits>> of a text: numbers in words with a unit, then in digits, then units in the
    dual; each kind in the order of the text. An and in front of a number in words isn't part of it."""
    longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
    word, unit = longest(VALUES | MULTIPLIED), longest(UNIT_OF)
    named = lambda w: F.element_at(_table(UNIT_OF), w)
    last = lambda m: F.regexp_extract(m, r"(\S+)$", 1)
    front = lambda m: F.regexp_replace(m, r"\s+\S+$", "")
    row = lambda m, value, several, digits: F.struct(m.alias("text"), value.cast("long").alias("value"), several.alias("unit"), F.lit(digits).alias("digits"))
    spelt = F.regexp_extract_all(text, F.lit(rf"(?<![א-ת])ו?((?:{word})(?:\s+ו?(?:{word}))*\s+(?:{unit}))(?![א-ת])"), F.lit(1))
    digits = F.regexp_extract_all(text, F.lit(rf"(?<![\d,.])((?:\d{{1,3}}(?:,\d{{3}})+|\d+)\s+(?:{unit}))(?![א-ת])"), F.lit(1))
    dual = F.regexp_extract_all(text, F.lit(rf"(?<![א-ת])({longest([f[1] for f in UNITS.values() if f[1]])})(?![א-ת])"), F.lit(1))
    return F.concat(
        F.filter(F.transform(spelt, lambda m: row(m, parsed_number(front(m)), named(last(m)), False)), lambda x: x["value"].isNotNull()),
        F.transform(digits, lambda m: row(m, F.regexp_replace(front(m), ",", ""), named(last(m)), True)),
        F.transform(dual, lambda m: row(m, F.lit(2), named(m), False)),
    )
