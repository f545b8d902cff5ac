"""Numbers and dates written in text, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kernwerk.functions.keys import EDGE

#: A number: a comma before exactly three digits or a space groups thousands; another comma or a point starts the decimals.
_GAP = r"[ \u00a0\u2007\u2009\u202f]"
NUMBER = rf"([-+−]?(?<![0-9])[0-9]+(?:(?:,|{_GAP})[0-9]{{3}}(?![0-9]))*(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+(?![0-9A-Za-z]))?)"


def number_token(text: Column) -> Column:
    """The first number as written, or ''."""
    return F.regexp_extract(text, NUMBER, 1)


def number_after(text: Column) -> Column:
    """What follows the first number (a unit, a scale), trimmed by the caller."""
    return F.regexp_extract(text, rf"(?s){NUMBER}(.*)$", 2)


def parse_number(text: Column) -> Column:
    """The first number of a text as double, or null.

    "12,114,000" and "9 351" are grouped, "0,17287" has a decimal comma, "1,234" is one thousand two hundred and thirty-four.
    """
    t = number_token(text)
    t = F.regexp_replace(t, rf"{_GAP}", "")
    t = F.regexp_replace(t, r",(?=[0-9]{3}(?![0-9]))", "")
    t = F.translate(t, ",−", ".-")
    return F.when(t != "", t.try_cast("double"))


def number_value(num: Column, text: Column) -> Column:
    """``num`` unless it is null or NaN, else the number in ``text``; null where there is none."""
    return F.when(num.isNotNull() & ~F.isnan(num), num).otherwise(parse_number(text))


def point_year(text: Column) -> Column:
    """Year of "Y", "Y-MM", "Y-MM-DD" or "Y BC" (negative); null where there is none."""
    y = F.regexp_extract(text, r"^\s*([0-9]{1,9})", 1)
    bc = text.rlike(r"(?i)\bB\.?C")
    return F.when(y != "", F.when(bc, -y.cast("int")).otherwise(y.cast("int")))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MON = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_ERA = r"(\s*(?:B\.?C\.?(?:E\.?)?|A\.?D\.?|C\.?E\.?))?"


def parse_date(text: Column) -> Column:
    """struct<year, month, day> of a date or year that the (proleptic Gregorian) calendar has, else null.

    Forms: "26 February 1627", "May 19, 1291", "March 1431", "1651-12-21", "1651-12", "1710", "679 BC". "circa" and
    the like before it are dropped. A year BC is negative; there is no year 0.
    """
    t = F.regexp_replace(F.regexp_replace(text, rf"^{EDGE}+|{EDGE}+$", ""), r"(?i)^(?:c\.|ca\.?|circa|about|around|approx\.?|~)\s*(?=\S*\d)", "")
    for pattern, form in (
        (rf"(?i)^(\d{{1,2}})\s+({_MON})\s+(\d{{1,4}}){_ERA}$", "$3|$2|$1|$4"),
        (rf"(?i)^({_MON})\s+(\d{{1,2}}),?\s+(\d{{1,4}}){_ERA}$", "$3|$1|$2|$4"),
        (rf"(?i)^({_MON})\s+(\d{{1,4}}){_ERA}$", "$2|$1||$3"),
        (r"^(\d{1,4})-(\d{1,2})(?:-(\d{1,2}))?$", "$1|$2|$3|"),
        (rf"(?i)^(\d{{1,4}}){_ERA}$", "$1|||$2"),
    ):
        t = F.regexp_replace(t, pattern, form)
    names = F.array(*(F.lit(m) for m in MONTHS))

    # Each step binds its parts once, as the variable of a lambda: written out, the expression would be copied into itself many times.
    def numbers(p: Column) -> Column:
        word = F.array_position(names, F.substring(F.lower(p[1]), 1, 3)).cast("int")
        return F.struct(p[0].try_cast("int").alias("y"), F.when(p[1] == "", F.lit(None)).when(word > 0, word).otherwise(F.coalesce(p[1].try_cast("int"), F.lit(0))).alias("m"), p[2].try_cast("int").alias("d"), p[3].rlike("(?i)B").alias("bc"))

    def checked(p: Column) -> Column:
        star = F.when(p["bc"], 1 - p["y"]).otherwise(p["y"])  # astronomical year, for leap days
        leap = ((star % 4 == 0) & (star % 100 != 0)) | (star % 400 == 0)
        length = F.when(p["m"] == 2, F.when(leap, 29).otherwise(28)).when(p["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        good = (p["y"] > 0) & (p["m"].isNull() | p["m"].between(1, 12)) & (p["d"].isNull() | ((p["d"] >= 1) & (p["d"] <= length)))
        return F.when(good, F.struct(F.when(p["bc"], -p["y"]).otherwise(p["y"]).alias("year"), p["m"].alias("month"), p["d"].alias("day")))

    parts = F.filter(F.array(F.split(t, r"\|", -1)), lambda x: F.size(x) == 4)
    return F.get(F.transform(F.transform(parts, numbers), checked), F.lit(0))


#: Texts that stand for an unknown value.
PLACEHOLDERS = ("", "-", "--", "–", "—", "?", "??", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "unkn.", "tbd", "tba", "undated", "circa unknown", "see note", "varies", "not known", "not available", "no value", "novalue", "some value", "somevalue", "unspecified", "missing", "...", "…")


def is_placeholder(text: Column) -> Column:
    """True for null, blank and placeholder texts."""
    t = F.lower(F.regexp_replace(text, rf"^{EDGE}+|{EDGE}+$", ""))
    return text.isNull() | t.isin(*PLACEHOLDERS)
