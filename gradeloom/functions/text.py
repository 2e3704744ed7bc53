"""Text rules of questions and papers. All functions take and return Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common words by which a line counts as English.
ENGLISH_WORDS = (
    "the of and is are which following in to from with by for was were correct select answer given "
    "below code statements statement only both not as at on it its that this be has have an or nor "
    "neither match list among these consider about who what when where how year first their there "
    "been will can also between under true false explanation reason assertion one other into than "
    "more most all any after before during state country government"
).split()

# Fixed values: (type, all patterns that the text must match), first fit wins. Case does not matter.
TYPES = (
    ("Assertion and reason", (r"assertion\s*\(?a\)?", r"reason\s*\(?r\)?")),
    ("Match the lists", (r"match\s+list|list\s*[-–]?\s*i\b.*list\s*[-–]?\s*ii",)),
    ("Order and chronology", (r"chronolog|arrange|correct\s+order|sequence",)),
    ("Matched pairs", (r"pairs?\b.*\bmatched",)),
    ("Statements", (r"statements?\b",)),
)


#: White space of any script, as a character class for Java and for DuckDB alike.
SPACES = "[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once: inside lambdas, Spark evaluates an expression wherever it is named."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trimmed(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, rf"^{SPACES}+|{SPACES}+\z", "")


def stem_text(stem: Column) -> Column:
    """Paragraphs and table cells of array<struct<type, text, rows>>, joined by spaces."""
    cells = lambda b: F.when(b["type"] == "p", F.coalesce(b["text"], F.lit(""))).otherwise(F.array_join(F.flatten(b["rows"]), " "))
    return F.array_join(F.transform(stem, cells), " ")


def question_type(text: Column, numbered: Column | None = None) -> Column:
    """Rough style of a question; numbered tells of a paragraph that starts with a digit, a full stop and a space."""
    kind = F.lit(None).cast("string")
    for name, patterns in TYPES:
        fits = F.lit(True)
        for p in patterns:
            fits = fits & text.rlike("(?i)" + p)
        if name == "Statements" and numbered is not None:
            fits = fits | numbered
        kind = F.coalesce(kind, F.when(fits, F.lit(name)))
    return F.coalesce(kind, F.lit("Direct question"))


def numbered_paragraph(stem: Column) -> Column:
    return F.coalesce(F.exists(stem, lambda b: (b["type"] == "p") & b["text"].rlike(r"^\d\.\s")), F.lit(False))


def norm(s: Column) -> Column:
    """Lower case words and numbers, single spaces; mends the usual slips of text recognition."""
    s = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"([a-z])(\d)", "$1 $2"), r"(\d)([a-z])", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(s, r"\bland\b", "1 and"), r"\b[il]\b", "1")
    return F.trim(F.regexp_replace(s, " +", " "))


def words(s: Column) -> Column:
    """Words of norm(s) of two characters or with a digit."""
    return normed_words(norm(s))


def normed_words(x: Column) -> Column:
    """words() of a text that is normalised already."""
    return F.filter(F.split(x, " "), lambda w: (F.length(w) > 1) | w.rlike(r"\d"))


def english_score(text: Column) -> Column:
    """Share of frequent words among the Latin words; 0 for mostly Devanagari; null without letters or words."""
    letters, deva = F.regexp_count(text, F.lit("[A-Za-zऀ-ॿ]")), F.regexp_count(text, F.lit("[ऀ-ॿ]"))
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    common = F.array(*map(F.lit, ENGLISH_WORDS))
    share = F.size(F.filter(found, lambda w: F.array_contains(common, F.lower(w)))) / F.size(found)
    return F.when(letters == 0, None).when(deva / letters > 0.3, F.lit(0.0)).when(F.size(found) > 0, share)


def devanagari_share(text: Column) -> Column:
    """Devanagari among the characters that are no white space; 0 without any."""
    seen = F.regexp_count(text, F.lit(r"\S"))
    return F.when(seen > 0, F.regexp_count(text, F.lit("[ऀ-ॿ]")) / seen).otherwise(F.lit(0.0))


def title_from_file(name: Column) -> Column:
    """File name without .pdf, underscores and runs of spaces as one space; a default where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf\z", ""), "_", " ")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(bare, f"{SPACES}+", " ")), F.lit("")), F.lit("Untitled test"))


def label_index(label: Column) -> Column:
    """a-e, A-E and 1-5 as 0-4, else null."""
    return F.when(label.rlike("^[a-eA-E]$"), F.ascii(F.lower(label)) - 97).when(label.rlike("^[1-5]$"), F.ascii(label) - 49)


def squeeze(s: Column) -> Column:
    """Letter-spaced words closed up, '( a )' as '(a)', single spaces."""
    s = F.when(s.rlike(r"^(?:\S ){2,}\S$"), F.regexp_replace(s, " ", "")).otherwise(s)
    s = F.regexp_replace(s, rf"\({SPACES}*([A-Za-z0-9]){SPACES}*\)", "($1)")
    return F.trim(F.regexp_replace(s, f"{SPACES}+", " "))
