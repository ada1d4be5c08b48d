"""Text normalising, abbreviations, keywords, tokens and row descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelled-out abbreviations, patterns in order; case is ignored.
ABBREVIATIONS = (
    (r"\bc/o\b", "complains of"),
    (r"\bSOB\b", "shortness of breath"),
    (r"\bDOE\b", "dyspnea on exertion"),
    (r"\bN&V\b", "nausea and vomiting"),
    (r"\br/o\b", "rule out"),
    (r"\bs/p\b", "status post"),
    (r"\bw/", "with"),
    (r"\bpt\b", "patient"),
    (r"\babd\b", "abdominal"),
    (r"\bh/a\b", "headache"),
    (r"\bfx\b", "fracture"),
    (r"\bMI\b", "myocardial infarction"),
    (r"\bx\s+(\d+)\s+days?\b", "times $1 days"),
    (r"\bx\s+(\d+)\b", "times $1"),
)

# Literal replacements in lower-case text, in order.
LITERALS = (
    ("n/v/d", "nausea, vomiting, diarrhea"),
    ("n/v", "nausea, vomiting"),
    ("lethagic", "lethargy"),
    ("s/p", "status post"),
    ("b pedal edema", "bilateral pedal edema"),
    ("abd", "abdominal"),
)

# Sides and quadrants, in order; case counts.
LOCATIONS = (
    (" L ", " left "),
    (" R ", " right "),
    (" L.", " left"),
    (" R.", " right"),
    ("L ", "left "),
    ("R ", "right "),
    (" LUQ ", " left upper quadrant "),
    (" LLQ ", " left lower quadrant "),
    (" RUQ ", " right upper quadrant "),
    (" RLQ ", " right lower quadrant "),
)

# Words that a keyword holding them is reduced to, the first one found.
KEYWORD_BASES = ("abdominal", "pain", "distention", "vomiting", "nausea", "lethargy")

# Common English words that tokens leave out.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)


def normalize(c: Column) -> Column:
    """Lower case, trimmed, white space as one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def clean(c: Column) -> Column:
    """``normalize`` with repeated ! ? . squeezed to the last one; null becomes the empty text."""
    return F.coalesce(F.regexp_replace(normalize(c), r"([!?.]){2,}", "$1"), F.lit(""))


def expand_abbreviations(c: Column) -> Column:
    """Patterns of ABBREVIATIONS in order, also inside ordinary words' borders ("pt", "mi"); null becomes ''."""
    return F.coalesce(reduce(lambda x, p: F.regexp_replace(x, "(?i)" + p[0], p[1]), ABBREVIATIONS, c), F.lit(""))


def complaint(c: Column) -> Column:
    return clean(expand_abbreviations(c))


def _literal(c: Column, table: tuple) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), table, c)


def expand_literals(c: Column) -> Column:
    """Lower case, then LITERALS in order. "abd" is replaced inside "abdominal" too, as given."""
    return _literal(F.lower(c), LITERALS)


def locations(c: Column) -> Column:
    """Sides and quadrants spelled out. Apply before lower-casing: the patterns are upper case."""
    return _literal(c, LOCATIONS)


def keywords(c: Column, most: int = 5) -> Column:
    """A comma-separated keyword list cleaned: single characters go, words holding a base become it, other marks go, repeats go."""
    parts = F.transform(F.split(F.trim(F.replace(F.lower(c), F.lit("，"), F.lit(","))), ","), lambda w: F.trim(w))
    parts = F.filter(parts, lambda w: F.length(w) > 1)

    def reduced(w: Column) -> Column:
        out = reduce(lambda rest, base: F.when(F.contains(w, F.lit(base)), F.lit(base)).otherwise(rest), reversed(KEYWORD_BASES), w)
        return F.regexp_replace(out, r"[^\p{L}\p{N}_\s-]", "")

    return F.coalesce(F.array_join(F.slice(F.array_distinct(F.transform(parts, reduced)), 1, most), ", "), F.lit(""))


def word_tokens(c: Column) -> Column:
    """What a plain vectorizer counts: lower-case runs of two or more letters, digits or underscores; no stop words. Null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def tokens(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of letters and digits, longer than two, that aren't stop words; null gives none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def hits(c: Column, phrases: tuple[str, ...]) -> Column:
    """Those of ``phrases`` that the lower-case text holds, in their order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def redact(c: Column, most: int = 50) -> Column:
    """Texts of over ``most`` characters cut, with three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


# Names of the four periods of the day.
PERIODS = ("Night (0-6AM)", "Morning (6AM-12PM)", "Afternoon (12PM-6PM)", "Evening (6PM-12AM)")


def describe_case(with_label: bool = False) -> Column:
    """A visit in lines of text; lines on arrival, period and keywords only where known. Leave the label out of queries."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
    say = lambda before, c, after="": F.concat(F.lit(before), known(c), F.lit(after))
    period = F.element_at(F.array(*map(F.lit, PERIODS)), F.col("time_period").cast("int") + 1)
    lines = [
        say("Chief Complaint: ", "chiefcomplaint"),
        say("Age: ", "age_at_visit", " years"),
        say("Gender: ", "gender"),
        F.lit("Vital Signs:"),
        say("- Heart Rate: ", "heartrate", " bpm"),
        F.concat(F.lit("- Blood Pressure: "), known("sbp"), F.lit("/"), known("dbp"), F.lit(" mmHg")),
        say("- Temperature: ", "temperature", " °F"),
        say("- Oxygen Saturation: ", "o2sat", "%"),
        say("- Pain Score: ", "pain", "/10"),
        F.concat(F.lit("Arrival Method: "), F.col("arrival_transport")),
        F.concat(F.lit("Arrival Time Period: "), period),
    ]
    if with_label:
        lines.append(F.concat(F.lit("Actual Triage Level: ESI "), F.col("acuity").cast("string")))
    return F.concat_ws("\n", *lines)


def prompt(description: Column) -> Column:
    """A request to a language model for a level of 1 to 5."""
    return F.concat(F.lit("Assign an ESI level of 1 (most urgent) to 5 (least urgent) to this patient.\n\n"), description, F.lit("\n\nAnswer with one line:\nTRIAGE LEVEL: <1-5>"))
