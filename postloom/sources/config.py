"""Configuration files: strict JSON lists and line files. They are small and read on the driver."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

COMPANY_KEYS = {"name", "aliases", "website", "hires_outside_ethiopia", "feeds", "career_pages"}
COMPANIES = "ord bigint, name string, aliases array<string>, website string, hires_outside boolean, feeds array<string>, career_pages array<string>"


def _strict(path: str, keys: set[str]) -> dict:
    raw = json.loads(Path(path).read_text())
    if not isinstance(raw, dict) or set(raw) - keys:
        raise ValueError(f"{path}: unknown keys {sorted(set(raw) - keys) if isinstance(raw, dict) else ''}")
    return raw


def _check_url(url: str) -> None:
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"{url!r} is no absolute http URL")


def priority_companies(spark: SparkSession, path: str) -> DataFrame:
    """The companies of a priority file: names are there and unique ignoring case, URLs are absolute."""
    entries = _strict(path, {"companies"}).get("companies") or []
    if not entries:
        raise ValueError(f"{path}: no companies")
    seen, rows = set(), []
    for k, e in enumerate(entries):
        if set(e) - COMPANY_KEYS:
            raise ValueError(f"{path}: unknown keys {sorted(set(e) - COMPANY_KEYS)}")
        name = str(e.get("name", "")).strip()
        if not name or name.lower() in seen:
            raise ValueError(f"{path}: company {k} has no name of its own")
        seen.add(name.lower())
        for url in [*filter(None, [e.get("website")]), *e.get("feeds", []), *e.get("career_pages", [])]:
            _check_url(url)
        rows.append((k, name, list(e.get("aliases", [])), e.get("website"), bool(e.get("hires_outside_ethiopia", False)), list(e.get("feeds", [])), list(e.get("career_pages", []))))
    return spark.createDataFrame(rows, COMPANIES)


def keywords(path: str) -> tuple[list[str], int]:
    """Search keywords, trimmed and unique ignoring case, and pages a keyword."""
    raw = _strict(path, {"keywords", "pages"})
    words = list({k.strip().lower(): k.strip() for k in reversed(raw.get("keywords") or []) if k.strip()}.values())[::-1]
    pages = raw.get("pages") or 1
    if not words or not isinstance(pages, int) or not 1 <= pages <= 10:
        raise ValueError(f"{path}: keywords, and pages from 1 to 10, are needed")
    return words, pages


def names(path: str) -> list[tuple[str, str | None]]:
    """(name, domain or None) from lines "Name" or "Name | domain"; # begins a comment line, the first of a name counts."""
    out: dict[str, tuple[str, str | None]] = {}
    for line in Path(path).read_text().splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            name, bar, domain = line.partition("|")
            out.setdefault(name.strip().lower(), (name.strip(), domain.strip().lower() or None if bar else None))
    if not out:
        raise ValueError(f"{path}: no names")
    return list(out.values())
