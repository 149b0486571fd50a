"""Column functions that bring legal titles and texts to comparable forms.

Each takes and returns a Column, so that everything stays in whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotation marks and hyphens that are typed in several ways, and Hebrew letters with a word-final form.
STRAIGHT = {"”": '"', "“": '"', "״": '"', "־": "-"}
APOSTROPHES = {"’": "'", "׳": "'"}
DASHES = {"–": "-", "—": "-"}
FINAL_LETTERS, PLAIN_LETTERS = "ךםןףץ", "כמנפצ"
PREFIX_LETTERS = "והבלמשכ"


def _mapped(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def straight_quotes(col: Column) -> Column:
    """One spelling for each quotation mark and for the hyphen that Hebrew typesetting uses."""
    return _mapped(col, STRAIGHT)


def unified_punctuation(col: Column) -> Column:
    return squeeze(_mapped(col, STRAIGHT | APOSTROPHES | DASHES))


def without_vowel_letters(col: Column) -> Column:
    """Drops vav and yod that don't begin a word."""
    return F.regexp_replace(col, r"(?<=[^ ])[וי]", "")


def _hebrew(letter: Column) -> Column:
    return letter.between("א", "ת")


def _opened(word: Column) -> Column:
    """The parts of a word around hyphens; a hyphen with a Hebrew letter on both sides becomes a blank."""
    glue = lambda before, after: F.when(_hebrew(F.right(before, F.lit(1))) & _hebrew(F.left(after, F.lit(1))), " ").otherwise("-")
    parts = F.split(word, "-")
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), lambda out, x: F.concat(out, glue(out, x), x))


def _without_year_article(word: Column) -> Column:
    """Hebrew years are letters with a quotation mark before the last; the article before such letters goes."""
    head = F.substring_index(word, '"', 1)
    run = F.element_at(F.split(head, "[^א-ת]"), -1)
    dated = F.contains(word, F.lit('"')) & run.startswith("הת") & F.length(run).between(2, 5)
    start = F.length(head) - F.length(run)
    return F.when(dated, F.concat(F.substr(word, F.lit(1), start), F.substr(word, start + 2))).otherwise(word)


def search_form(col: Column) -> Column:
    """Titles word by word: compounds open up, separators go, then vowel letters within words, then years' articles."""
    opened = F.transform(F.split(F.translate(straight_quotes(col), ":;,", "   "), r"\s+"), _opened)
    words = F.filter(F.split(F.array_join(opened, " "), " "), lambda w: w != "")
    short = F.transform(words, lambda w: F.concat(F.left(w, F.lit(1)), F.translate(F.substr(w, F.lit(2)), "וי", "")))
    return F.array_join(F.transform(short, _without_year_article), " ")


def compact_form(col: Column) -> Column:
    return F.translate(F.replace(col, F.lit(" "), F.lit("")), FINAL_LETTERS, PLAIN_LETTERS)


def _without_last_bracket(title: Column) -> Column:
    """A title that ends in a bracketed remark, without that remark."""
    remark = F.length(F.substring_index(title, "[", -1)) + 1
    return F.when(title.endswith("]") & F.contains(title, F.lit("[")), F.trim(F.substr(title, F.lit(1), F.length(title) - remark))).otherwise(title)


def _closing_year(head: Column) -> Column:
    digits = F.right(head, F.lit(4))
    return F.when((F.left(F.right(head, F.lit(5)), F.lit(1)) == "-") & (F.length(F.translate(digits, "0123456789", "")) == 0), digits)


def title_year(col: Column) -> Column:
    """The year at the end of a title, or null."""
    return _closing_year(_without_last_bracket(unified_punctuation(col)))


def base_title(col: Column) -> Column:
    """The name in a title: what stands before the comma of the official year, without bracketed remarks and hyphens."""
    title = unified_punctuation(col)
    head = _without_last_bracket(title)
    last = F.trim(F.substring_index(head, ",", -1))
    letters = F.substr(last, F.lit(1), F.length(last) - 5)
    official = F.contains(head, F.lit(",")) & _closing_year(head).isNotNull() & (letters != "") & ~letters.rlike("[^א-ת\"']")
    name = F.when(official, F.substr(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, ",", -1)) - 1)).otherwise(title)
    pieces = F.transform(F.split(name, r"\["), lambda x, i: F.when(i == 0, x).when(F.contains(x, F.lit("]")), F.substr(x, F.instr(x, "]") + 1)).otherwise(F.concat(F.lit("["), x)))
    return squeeze(F.translate(F.array_join(pieces, " "), "-", " "))


def display_date(col: Column) -> Column:
    """ISO dates as DD.MM.YYYY; anything else as it is."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})([T ].*)?$"
    return F.when(col.rlike(iso), F.regexp_replace(col, iso, "$3.$2.$1")).otherwise(col)


def content_words(col: Column, stopwords: list[str], shortest: int = 3) -> Column:
    """Distinct words of a title that say what it is about: years, words of a given list and very short ones go."""
    words = F.split(squeeze(F.translate(col, "(),\"'׳״-–", " " * 9)), " ")
    year = lambda w: (F.length(w) == 4) & F.coalesce(w.try_cast("int").between(1800, 2099), F.lit(False))
    hebrew_year = lambda w: w.startswith("הת") & F.length(w).between(3, 6) & ~w.rlike("[^א-ת]")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(stopwords) & ~year(w) & ~hebrew_year(w)))


def longest_words(words: Column, n: int = 2) -> Column:
    """The n longest words, ties in alphabetical order."""
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["w"])


def word_count(col: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.regexp_replace(col, r"^\s*\d+[.)]\s*", "")), r"\s+"), lambda w: w != ""))


def sentences(col: Column) -> Column:
    """Cuts after a full stop, an exclamation or a question mark with white space behind it, and at U+2029."""
    marked = F.regexp_replace(F.trim(col), r"([.!?])\s+", "$1\u2029")
    return F.filter(F.split(marked, "\u2029"), lambda s: s != "")


def short_hash(col: Column, digits: int = 8) -> Column:
    return F.substring(F.sha1(F.encode(col, "UTF-8")), 1, digits)


def joined_hash(*cols: Column) -> Column:
    """MD5 of texts with unit separators between; null counts as empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in cols]))


def match_form(col: Column) -> Column:
    """Titles and terms as they are compared: plain quotation marks, hyphens as blanks, single blanks."""
    return squeeze(F.translate(unified_punctuation(col), "-", " "))


def term_matches(term: str, title: Column) -> Column:
    """Every word of the term stands in the title: a title word, after up to three prefix letters, begins with it; words
    of up to three letters must equal it."""
    plain = term.translate(str.maketrans(STRAIGHT | APOSTROPHES | DASHES)).replace("-", " ")
    out = F.lit(True)
    for w in plain.split():
        tail = r"(?![\p{L}\p{N}])" if len(w) <= 3 else ""
        out = out & match_form(title).rlike(rf"(?<![\p{{L}}\p{{N}}])[{PREFIX_LETTERS}]{{0,3}}\Q{w}\E{tail}")
    return out


def facets_match(facets: list[list[str]], title: Column) -> Column:
    """Every facet has a term that matches; no facets match everything."""
    out = F.lit(True)
    for facet in facets:
        any_term = F.lit(False)
        for term in facet:
            any_term = any_term | term_matches(term, title)
        out = out & any_term
    return out
