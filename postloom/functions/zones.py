"""Time zones that texts ask for, as windows of offsets from UTC."""

from __future__ import annotations

import re
from typing import NamedTuple

# Offsets in hours by abbreviation (in capitals only) and by name, and windows of families of zones.
ABBREVIATIONS = {
    "PST": -8, "PDT": -7, "PT": -8, "MST": -7, "MDT": -6, "MT": -7, "CST": -6, "CDT": -5, "CT": -6, "EST": -5, "EDT": -4, "ET": -5, "AST": -4, "NST": -3.5, "HST": -10,
    "AKST": -9, "AKDT": -8, "BRT": -3, "ART": -3, "CLT": -4, "COT": -5, "PET": -5, "GMT": 0, "UTC": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2,
    "EEST": 3, "MSK": 3, "TRT": 3, "EAT": 3, "WAT": 1, "CAT": 2, "SAST": 2, "IST": 5.5, "PKT": 5, "BDT": 6, "ICT": 7, "WIB": 7, "SGT": 8, "HKT": 8, "PHT": 8, "AWST": 8,
    "JST": 9, "KST": 9, "ACST": 9.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}
NAMES = {
    "central european time": 1, "central european summer time": 2, "eastern european time": 2, "western european time": 0, "east africa time": 3, "east african time": 3,
    "west africa time": 1, "south africa standard time": 2, "pacific time": -8, "pacific standard time": -8, "mountain time": -7, "mountain standard time": -7,
    "central time": -6, "central standard time": -6, "eastern time": -5, "eastern standard time": -5, "eastern daylight time": -4, "greenwich mean time": 0,
    "british summer time": 1, "india standard time": 5.5, "japan standard time": 9, "moscow time": 3, "gulf standard time": 4, "singapore time": 8,
}
FAMILIES = (
    (r"\b(?:us|usa|u\.s\.a?\.?|united states|north american?|american?)\s+(?:time ?zones?|hours|business hours)", -10, -3),
    (r"\b(?:latam|latin american?|south american?)\s+(?:time ?zones?|hours)", -6, -3),
    (r"\b(?:emea)\s+(?:time ?zones?|hours)", 0, 4),
    (r"\b(?:african?|africa)\s+(?:time ?zones?|hours)", -1, 4),
    (r"\b(?:european?|europe|eu)\s+(?:time ?zones?|hours|business hours)", 0, 2),
    (r"\b(?:apac|asia[- ]pacific|asian?)\s+(?:time ?zones?|hours)", 5, 13),
    (r"\b(?:uk|british)\s+(?:time ?zones?|hours)", 0, 1),
)
# How offsets, ranges and distances are written.
OFFSET = r"([+\-−])\s*(\d{1,2})(?::?(\d{2}))?"
ONE = re.compile(rf"\b(?:utc|gmt)\s*{OFFSET}", re.I | re.A)
RANGE = re.compile(rf"(?:utc|gmt)\s*{OFFSET}\s*(?:to|-|–|—|and|/)\s*(?:utc|gmt)?\s*{OFFSET}", re.I | re.A)
AROUND = re.compile(r"(?:\+\s*/?\s*-|±|plus or minus|plus/minus|within)\s*(\d{1,2}(?:\.\d)?)\s*(?:hours?|hrs?|h)\b", re.I | re.A)
HOURS_OF = re.compile(r"(\d{1,2}(?:\.\d)?)\s*(?:hours?|hrs?)\s+(?:of|from|to)", re.I | re.A)
SHORT_WORD = re.compile(r"\b([A-Za-z]{2,4})\b", re.A)
_NAMES = [(re.compile(re.escape(n), re.I), hours) for n, hours in NAMES.items()]
_FAMILIES = [(re.compile(p, re.I | re.A), low, high) for p, low, high in FAMILIES]
#: A text without any of these names no zone; the look is cheap.
_HINT = re.compile(r"utc|gmt|time|hours|\b(?:" + "|".join(sorted(ABBREVIATIONS)) + r")\b", re.I | re.A)


class Window(NamedTuple):
    low: float
    high: float
    text: str

    def distance(self, offset: float) -> float:
        return max(self.low - offset, offset - self.high, 0.0)


def hours(sign: str, whole: str, minutes: str | None) -> float:
    return (int(whole) + int(minutes or 0) / 60) * (1 if sign == "+" else -1)


def _at(text: str, start: int, end: int, offset: float) -> Window:
    """One zone, widened by "+/- N hours" right after it or "N hours of" right before it."""
    after = AROUND.search(text, end, end + 40)
    by = after[1] if after and after.start() - end <= 6 else None
    if by is None and (before := HOURS_OF.search(text[max(0, start - 30) : start])):
        by = before[1]
    return Window(offset - float(by or 0), offset + float(by or 0), text[start:end])


def time_windows(text: str) -> list[Window]:
    """The windows a text asks for: ranges, single offsets, names, families, then abbreviations that none of them holds."""
    if not _HINT.search(text):
        return []
    out, spans = [], []
    for m in RANGE.finditer(text):
        out.append(Window(*sorted((hours(*m.group(1, 2, 3)), hours(*m.group(4, 5, 6)))), m[0]))
        spans.append(m.span())
    out += [_at(text, *m.span(), hours(*m.groups())) for m in ONE.finditer(text) if not any(a <= m.start() and m.end() <= b for a, b in spans)]
    out += [_at(text, *m.span(), offset) for pattern, offset in _NAMES for m in pattern.finditer(text)]
    out += [Window(low, high, m[0]) for pattern, low, high in _FAMILIES for m in pattern.finditer(text)]
    for m in SHORT_WORD.finditer(text):
        if m[1] in ABBREVIATIONS and not any(len(w.text) > len(m[1]) and m[1].lower() in w.text.lower() for w in out):
            out.append(_at(text, *m.span(), ABBREVIATIONS[m[1]]))
    return out


def distance(windows: list[Window], offset: float) -> float:
    """Hours from the offset to the nearest window; 0 inside one."""
    return min((w.distance(offset) for w in windows), default=float("inf"))
