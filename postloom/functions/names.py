"""Comparison keys of employer names and job titles, and names that stand in for an employer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing words of company names that say only its form or country.
CORPORATE = ("inc", "plc", "sc", "s", "c", "ltd", "llc", "pvt", "co", "company", "limited", "corp", "corporation", "sa", "gmbh", "et", "ethiopia")
# Name keys shown in place of a hidden employer.
PLACEHOLDERS = ("confidential", "anonymous", "linkedin", "hiring", "jobs", "job", "recruiter", "recruitment", "company", "not-specified", "n-a", "na", "unknown")


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits, everything between them one dash."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def name_key(c: Column) -> Column:
    """The slug without dots and without trailing corporate words; the first word always stays."""
    return F.regexp_replace(slug(F.replace(c, F.lit("."), F.lit(""))), f"(-({'|'.join(CORPORATE)}))+$", "")


def title_key(c: Column) -> Column:
    """Lower-case letters and digits of any script, # and +; everything between them one space."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}#+]+", " "))


def is_placeholder_employer(c: Column) -> Column:
    """Addresses, names without letters or digits, and known stand-ins; names in other scripts are real."""
    key = name_key(c)
    address = c.contains("://") | c.contains("@")
    return F.when(address, True).when(key == "", ~c.rlike(r"[\p{L}\p{Nd}]")).otherwise(key.isin(*PLACEHOLDERS))


def company_key(c: Column) -> Column:
    """What makes a company name unique: lower case, without spaces at both ends."""
    return F.lower(F.btrim(c))


def website_key(c: Column) -> Column:
    """Lower case, without spaces at both ends and trailing slashes."""
    return F.regexp_replace(F.lower(F.btrim(c)), "/+$", "")
