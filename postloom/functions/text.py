"""Text columns: trimming, cleaning, vocabulary mapping and content hashes. All are native expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space characters of Unicode, for trims that know more than U+0020.
UNICODE_SPACE = r"\t\n\x0B\f\r \x85\xA0  -     　"

# What sources write for each term of the employment and workplace vocabularies, without - _ and spaces.
EMPLOYMENT = {
    "full_time": ("fulltime", "permanent", "regular"),
    "part_time": ("parttime",),
    "contract": ("contract", "contractor", "freelance", "temporary", "temp", "fixedterm"),
    "internship": ("intern", "internship"),
}
WORKPLACE = {"remote": ("remote",), "hybrid": ("hybrid",), "onsite": ("onsite", "inoffice", "office")}


def trim_space(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", "")


def collapse_space(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, rf"[{UNICODE_SPACE}]+", " "))


def clean_text(c: Column) -> Column:
    """Without NUL characters, then trimmed."""
    return trim_space(F.replace(c, F.lit("\x00"), F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_space(c), F.lit(""))


def vocabulary(c: Column, terms: Mapping[str, tuple[str, ...]]) -> Column:
    """The term whose spellings hold c, ignoring case, dashes, underscores and spaces; '' for none."""
    plain = F.lower(F.translate(F.coalesce(c, F.lit("")), "-_ ", ""))
    out = F.lit("")
    for term, spellings in reversed(terms.items()):
        out = F.when(plain.isin(*spellings), F.lit(term)).otherwise(out)
    return out


def employment_type(c: Column) -> Column:
    return vocabulary(c, EMPLOYMENT)


def workplace_type(c: Column) -> Column:
    return vocabulary(c, WORKPLACE)


def workplace_from_location(c: Column) -> Column:
    """Hybrid before a negated or partial remote (which says nothing) before remote; '' otherwise. The pattern is a fixed value."""
    partial = r"(?i)(non[- ]?|not |no |semi[- ]|partially )remote|remote[- ](friendly|first|optional|eligible|possible)"
    return F.when(c.rlike(r"(?i)\bhybrid\b"), "hybrid").when(c.rlike(partial), "").when(c.rlike(r"(?i)\bremote\b"), "remote").otherwise("")


def content_hash(title: Column, description: Column, application_url: Column, canonical_url: Column, location: Column, remote: Column, employment: Column) -> Column:
    """SHA-256 of the fields, each ended by NUL; the last two take part only when they say something."""
    nul = F.lit("\x00")
    parts = [F.concat(F.coalesce(c, F.lit("")), nul) for c in (title, description, application_url, canonical_url, location)]
    parts += [F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, nul)).otherwise("") for c in (remote, employment)]
    return F.sha2(F.concat(*parts), 256)


def truncate(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def string_list(c: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    kind = "array<string>"
    fits = F.coalesce(c.rlike(r"^\s*\["), F.lit(False))
    found = F.when(fits, F.from_json(c, kind))
    return F.coalesce(F.when(~F.exists(F.coalesce(found, F.array().cast(kind)), lambda x: x.isNull()), found), F.array().cast(kind))


def evidence_list(c: Column) -> Column:
    """A JSON list of objects with field and text; anything else is an empty list, and what an object lacks is ''."""
    kind = "array<struct<field:string,text:string>>"
    found = F.when(F.coalesce(c.rlike(r"^\s*\["), F.lit(False)), F.from_json(c, kind))
    named = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(F.coalesce(x["field"], F.lit("")).alias("field"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return F.coalesce(named, F.array().cast(kind))
