"""Which paths a site's robots file allows."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNRESERVED = re.compile(r"%([0-9A-Fa-f]{2})")


def normal(path: str) -> str:
    """Percent escapes of unreserved characters decoded, the others in upper case."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c.isascii() and (c.isalnum() or c in "-._~") else m[0].upper()

    return UNRESERVED.sub(one, path)


def rules_for(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the groups that name the agent, or else of those for all."""
    own: list[tuple[bool, str]] = []
    everyone: list[tuple[bool, str]] = []
    named = in_own = in_all = after_agent = False
    for line in re.split(r"\r\n|\r|\n", text.removeprefix("﻿")):
        key, colon, value = line.split("#", 1)[0].partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not after_agent:
                in_own = in_all = False
            after_agent = True
            if value == "*":
                in_all = True
            elif value and value.lower() == agent.lower():
                in_own = named = True
        elif key in ("allow", "disallow"):
            after_agent = False
            if value:
                rule = (key == "allow", normal(value))
                own += [rule] * in_own
                everyone += [rule] * in_all
    return own if named else everyone


@lru_cache(maxsize=4096)
def segments(p: str) -> tuple[tuple[str, ...], bool]:
    """What stands between the stars of a pattern, and whether it ends with the path."""
    end = p.endswith("$")
    return tuple(re.split(r"\*+", p[:-1] if end else p)), end


def fits(p: str, path: str) -> bool:
    """* stands for any run of characters, $ at the end for the path's end; anything else is a prefix. Every segment is taken
    where it comes first, which leaves most for those after it, so the path is passed over once."""
    (first, *rest), end = segments(p)
    if not path.startswith(first):
        return False
    if not rest:
        return not end or len(path) == len(first)
    *middle, tail = rest
    at = len(first)
    for part in middle:
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return path.endswith(tail) and len(path) - len(tail) >= at if end else path.find(tail, at) >= 0


def allows(text: str | None, path: str, agent: str, status: int = 200) -> bool | None:
    """Whether the path may be fetched: the longest matching rule decides, and of equal ones the one that allows. None when
    the file could not be had (busy or broken servers), which means not now. Files with NUL bytes allow nothing."""
    if status == 429 or status >= 500:
        return None
    if 400 <= status < 500:
        return True
    if "\x00" in (text or ""):
        return False
    own = normal(path)
    found = [(len(p), allow) for allow, p in rules_for(text or "", agent) if fits(p, own)]
    return max(found)[1] if found else True


def allows_column(text: Column, path: Column, agent: str) -> Column:
    @F.pandas_udf("boolean")
    def each(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([allows(a, b or "/", agent) for a, b in zip(t, p, strict=True)], dtype="boolean")

    return each(text, path)
