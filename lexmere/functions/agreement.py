"""Agreement of verbs with their subjects, as column functions over closed tables: what isn't in them has no form."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Infinitives with their future forms (masculine, feminine, plural), modals with theirs (masculine, feminine,
# plural, feminine plural), further pairs, nouns that open an actor's name by gender, and words that negate.
VERBS = {
    "לתקן": ("יתקן", "תתקן", "יתקנו"),
    "לקבוע": ("יקבע", "תקבע", "יקבעו"),
    "למנות": ("ימנה", "תמנה", "ימנו"),
    "לפרסם": ("יפרסם", "תפרסם", "יפרסמו"),
    "להגיש": ("יגיש", "תגיש", "יגישו"),
    "להודיע": ("יודיע", "תודיע", "יודיעו"),
    "לאשר": ("יאשר", "תאשר", "יאשרו"),
    "להעביר": ("יעביר", "תעביר", "יעבירו"),
    "להתקין": ("יתקין", "תתקין", "יתקינו"),
    "לתת": ("ייתן", "תיתן", "ייתנו"),
    "להחליט": ("יחליט", "תחליט", "יחליטו"),
    "להביא": ("יביא", "תביא", "יביאו"),
    "להורות": ("יורה", "תורה", "יורו"),
    "להקים": ("יקים", "תקים", "יקימו"),
    "לבחון": ("יבחן", "תבחן", "יבחנו"),
    "לדווח": ("ידווח", "תדווח", "ידווחו"),
    "לבטל": ("יבטל", "תבטל", "יבטלו"),
    "להעניק": ("יעניק", "תעניק", "יעניקו"),
    "למסור": ("ימסור", "תמסור", "ימסרו"),
    "להזמין": ("יזמין", "תזמין", "יזמינו"),
    "להתיר": ("יתיר", "תתיר", "יתירו"),
    "להקצות": ("יקצה", "תקצה", "יקצו"),
    "להוציא": ("יוציא", "תוציא", "יוציאו"),
    "לשלם": ("ישלם", "תשלם", "ישלמו"),
    "לפעול": ("יפעל", "תפעל", "יפעלו"),
    "לחייב": ("יחייב", "תחייב", "יחייבו"),
}
MODALS = {"רשאי": ("רשאי", "רשאית", "רשאים", "רשאיות"), "חייב": ("חייב", "חייבת", "חייבים", "חייבות")}
NUMBERS = ("m", "f", "pl", "fpl")
OTHER_PAIRS = {"יכין": "תכין", "יחתום": "תחתום", "יאציל": "תאציל", "רשאי": "רשאית", "חייב": "חייבת", "מוסמך": "מוסמכת", "אחראי": "אחראית"}
MASCULINE = ("שר", "ראש", "יועץ", "מנהל", "ממונה", "רשם", "מפקח", "נגיד", "מבקר", "סגן", "ועד", "וועד", "קוסם", "נציב", "יושב", 'מנכ"ל', "דמבלדור", "אפוטרופוס", 'יועמ"ש', "בית", "צוות")
FEMININE = ("ממשלה", "מועצה", "מועצת", "רשות", "ועדה", "ועדת", "נציבות", "מליאה", "הנהלה", "הנהלת", "לשכה", "לשכת", "מזכירות", "חברה", "עירייה", "עיריית")
NEGATIONS = ("אינו", "אינה", "אינם", "אינן", "לא", "אין")

#: By these tables, every form with its modal (none for the future), infinitive and number.
FORMS = {forms[i]: ("", inf, NUMBERS[i]) for inf, forms in VERBS.items() for i in range(3)}
FORMS |= {f"{form} {inf}": (modal, inf, NUMBERS[i]) for modal, forms in MODALS.items() for i, form in enumerate(forms) for inf in VERBS}
PAIRS = {forms[0]: forms[1] for forms in VERBS.values()} | OTHER_PAIRS


def table(values: dict[str, str]) -> Column:
    """A constant map, as one literal."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), "map<string,string>")


def said(modal: str, infinitive: str, number: str) -> str | None:
    """A form by its parts; the future has one plural for both genders."""
    if infinitive not in VERBS or number not in NUMBERS or modal not in ("", *MODALS):
        return None
    return f"{MODALS[modal][NUMBERS.index(number)]} {infinitive}" if modal else VERBS[infinitive][min(NUMBERS.index(number), 2)]


def verb_form(phrase: Column) -> Column:
    """struct<modal, infinitive, number> of a form, null for others."""
    part = lambda k: F.element_at(table({form: parts[k] for form, parts in FORMS.items()}), phrase)
    return F.when(part(1).isNotNull(), F.struct(part(0).alias("modal"), part(1).alias("infinitive"), part(2).alias("number")))


def conjugate(modal: Column, infinitive: Column, number: Column) -> Column:
    """The form with these parts, null if there is none."""
    forms = {f"{m}|{inf}|{n}": said(m, inf, n) for m in ("", *MODALS) for inf in VERBS for n in NUMBERS}
    return F.element_at(table(forms), F.concat_ws("|", modal, infinitive, number))


def gender(phrase: Column) -> Column:
    """m or f by the noun that opens an actor's name, with or without an article; null for other nouns."""
    genders = table({w: "m" for w in MASCULINE} | {w: "f" for w in FEMININE})
    head = F.regexp_extract(phrase, r"^\s*(\S+)", 1)
    bare = F.when(head.startswith("ה"), F.element_at(genders, F.substr(head, F.lit(2))))
    return F.coalesce(bare, F.element_at(genders, head))


def inflect(word: Column, to: Column) -> Column:
    """A verb's or an adjective's form in the other gender or, if it has that gender, itself; null for other words."""
    own = table({m: "m" for m in PAIRS} | {f: "f" for f in PAIRS.values()})
    other = table(PAIRS | {f: m for m, f in PAIRS.items()})
    return F.when(F.element_at(own, word) == to, word).otherwise(F.element_at(other, word))
