"""Places written in job locations: the home country, cities, and whether two locations may be one opening's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import clean_text, collapse_space

# Fixed values, which have to accept what sources write: the home country, the spellings of its capital, what names them in a
# location and in free text, and the phrases around the place in a search result.
COUNTRY, CAPITAL, SPELLINGS = "ethiopia", "addis ababa", ("addis", "addis abeba", "addis ababa")
IN_LOCATION, IN_TEXT = r"\b(?:ethiopia|addis)\b", r"\b(?:ethiopia|addis ababa|addis abeba)\b"
SNIPPET_PLACE = (r"(?i)\bat .{1,120}? in ([^.]{2,80})\.", r"(?i)\bget notified about new .{1,120}? jobs in ([^.]{2,80})\.")
TITLE_PLACE = r"(?i)\bhiring .+? in ([^|]{2,80}?)[\t\n\f\r ]*(?:\||\z)"


def in_ethiopia(c: Column) -> Column:
    """A location names the country, or the capital by its first word, as whole words."""
    return F.lower(c).rlike(IN_LOCATION)


def in_ethiopia_text(c: Column) -> Column:
    """As in_ethiopia for running text, in which only the capital's whole name counts."""
    return F.lower(c).rlike(IN_TEXT)


def city_key(c: Column) -> Column:
    """The part before the first comma, in lower case, with the capital's spellings made one; '' if it names no city."""
    first = collapse_space(F.lower(F.substring_index(F.coalesce(c, F.lit("")), ",", 1)))
    return F.when(first == COUNTRY, "").when(first.isin(*SPELLINGS), CAPITAL).otherwise(first)


def has_city(c: Column) -> Column:
    return city_key(c) != ""


def same_place(a: Column, b: Column) -> Column:
    """Equal cities, or one location without a city and the other in the home country. Not transitive."""
    ka, kb = city_key(a), city_key(b)
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (ka == kb) | F.when(ka == "", in_ethiopia(b)).when(kb == "", in_ethiopia(a)).otherwise(False)


def clean_location(c: Column) -> Column:
    """Single spaces, none before a comma, and no trailing separators."""
    plain = F.regexp_replace(clean_text(c), r"[\t\n\f\r ]+", " ")
    return F.regexp_replace(F.replace(plain, F.lit(" ,"), F.lit(",")), r"[,;\t\n\f\r ]+$", "")


def unspecified(c: Column) -> Column:
    return F.when(F.lower(c).isin("not specified", "n/a", "none"), "").otherwise(c)


def join_location(city: Column, state: Column) -> Column:
    """"city, state"; one of them alone when the other is missing or the same word."""
    c, s = (unspecified(clean_text(F.coalesce(x, F.lit("")))) for x in (city, state))
    return F.when((c == "") | (F.lower(c) == F.lower(s)), s).when(s == "", c).otherwise(F.concat(c, F.lit(", "), s))


def strip_flags(c: Column) -> Column:
    """Without regional-indicator symbols, the halves of flags, and the spaces they leave."""
    return collapse_space(F.regexp_replace(c, r"[\x{1F1E6}-\x{1F1FF}]", ""))


def result_location(title: Column, snippet: Column) -> Column:
    """The location in a search result's sentence or title; '' if there is none or it was cut off."""
    tries = [*(F.regexp_extract(snippet, p, 1) for p in SNIPPET_PLACE), F.regexp_extract(title, TITLE_PLACE, 1)]
    found = clean_text(F.coalesce(*(F.nullif(t, F.lit("")) for t in tries), F.lit("")))
    return F.when(found.endswith("...") | found.endswith("…"), "").otherwise(found)
