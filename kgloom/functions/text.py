"""Text functions as column expressions; the one without a built-in form is an Arrow UDF."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Fixed value: characters taken off both ends of a name.
EDGE = " .,;:()[]{}\"'-"
#: White space of any kind, no-break spaces included.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Numerals that become digits when they stand alone, in this order.
NUMERALS = (("i", "1"), ("ii", "2"), ("iii", "3"), ("iv", "4"), ("v", "5"))
#: Abbreviations and what they stand for.
ABBREVIATIONS = {
    "t2dm": "type 2 diabetes mellitus", "t1dm": "type 1 diabetes mellitus", "dm": "diabetes mellitus", "mi": "myocardial infarction",
    "copd": "chronic obstructive pulmonary disease", "htn": "hypertension", "chf": "congestive heart failure", "cad": "coronary artery disease",
    "ckd": "chronic kidney disease", "ra": "rheumatoid arthritis", "oa": "osteoarthritis", "af": "atrial fibrillation", "dvt": "deep vein thrombosis",
    "pe": "pulmonary embolism", "cva": "cerebrovascular accident", "gerd": "gastroesophageal reflux disease", "ibs": "irritable bowel syndrome",
    "uti": "urinary tract infection", "hiv": "human immunodeficiency virus", "aids": "acquired immunodeficiency syndrome",
}


def normal_form(c: Column) -> Column:
    """Lower case, runs of any white space as one blank, edge blanks and punctuation off; null gives ''."""
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(c), SPACE, " "), F.lit(EDGE)), F.lit(""))


def normal_cui(c: Column) -> Column:
    """Trimmed of blanks, upper case; null stays null."""
    return F.upper(F.btrim(c))


def phrase(c: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and blanks as a blank, ends trimmed; inner blanks stay."""
    return F.btrim(F.regexp_replace(F.lower(c.cast("string")), "[^A-Za-z0-9 ]", " "))


def name(c: Column) -> Column:
    """Lower case, lone numerals as digits, white space collapsed, edge punctuation off."""
    x = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    for roman, digit in NUMERALS:
        x = F.replace(x, F.lit(f" {roman} "), F.lit(f" {digit} "))
    return F.btrim(F.btrim(F.regexp_replace(x, SPACE, " ")), F.lit(EDGE.strip()))


def words(c: Column) -> Column:
    """Tokens between white space, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def expand(c: Column, mapping: dict[str, str] = ABBREVIATIONS) -> Column:
    """Each word that is an abbreviation replaced by what it stands for; words in lower case, one blank between."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.array_join(F.transform(words(F.lower(c)), lambda w: F.coalesce(F.try_element_at(m, w), w)), " ")


def answer(c: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles dropped, white space collapsed."""
    x = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    x = F.regexp_replace(x, r"\b(a|an|the)\b", " ")
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def extract_answer(c: Column) -> Column:
    """What follows the first 'Answer:' where there is an 'Answer: ', else all of it."""
    return F.when(F.instr(c, "Answer: ") > 0, F.btrim(F.split(c, "Answer:")[1])).otherwise(c)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct lower-case words; null if neither has any."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)))


def containment(a: Column, keys: Column) -> Column:
    """Share of the distinct words of ``a`` that are in ``keys``."""
    x = F.array_distinct(words(F.lower(a)))
    return F.try_divide(F.size(F.array_intersect(x, keys)).cast("double"), F.size(x))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, without case; 1 for two empty texts."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def ngrams(c: Column, n: int = 3) -> Column:
    """Character n-grams of the lower-case text with white space collapsed; none if it is shorter than ``n``."""
    x = F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def first_json(s: str | None) -> str | None:
    """The first JSON object within a text, of any length; null if the first balanced braces hold none.

    What begins at the first brace is read by a JSON parser, which minds braces in strings. Where that
    fails, the first brace that is ever closed counts, found in one pass over the text.
    """
    at = s.find("{") if s is not None else -1
    if at < 0:
        return None
    try:
        return s[at : json.JSONDecoder().raw_decode(s, at)[1]]
    except (ValueError, RecursionError):
        pass
    open_, best = [], None
    for m in re.finditer(r"[{}]", s):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            start = open_.pop()
            if best is None or start < best[0]:
                best = (start, m.end())
            if not open_:
                break
    # With a brace left open before it, an object that is closed may still hold others; the least start stands.
    if best is None:
        return None
    try:
        json.loads(s[best[0] : best[1]])
    except (ValueError, RecursionError):
        return None
    return s[best[0] : best[1]]


@F.pandas_udf(StringType())
def json_object(c: pd.Series) -> pd.Series:
    """The first JSON object within each text, as JSON text; null if there is none. A regular expression in the JVM would recurse once a character."""
    return pd.Series([first_json(s) for s in c], dtype=object)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lower-case texts; null if either is null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def may_reach(a: Column, b: Column, ratio: float) -> Column:
    """Whether the lengths of two texts let their :func:`sequence_ratio` exceed ``ratio``: it is at most twice the shorter over both."""
    return 2 * F.least(F.length(a), F.length(b)) > ratio * (F.length(a) + F.length(b))


def lookup_key(c: Column) -> Column:
    """The key under which names are looked up: normalised, then abbreviations expanded."""
    return expand(name(c))
