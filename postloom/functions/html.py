"""HTML to text and pages to their parts. Plain functions over strings, and Arrow functions that apply them to columns."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that part paragraphs, lines and cells, and tags whose content is no prose.
PARAGRAPHS = frozenset(("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "table", "section", "article"))
LINES = frozenset(("br", "li", "ul", "ol", "tr", "dt", "dd"))
CELLS = frozenset(("td", "th"))
DROPPED = frozenset(("script", "style", "noscript", "template"))
# Parts of a page around its main text, and the tags that hold it, best first.
CHROME, MAIN = frozenset(("nav", "footer", "aside")), ("main", "article", "body")


class _Flow(HTMLParser):
    """Collects text and breaks: a list of strings, with 1 for a line's end and 2 for a paragraph's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str | int] = []
        self.hidden = 0

    def mark(self, tag: str) -> None:
        if tag in PARAGRAPHS:
            self.parts.append(2)
        elif tag in LINES:
            self.parts.append(1)
        elif tag in CELLS:
            self.parts.append(" ")

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        else:
            self.mark(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
        else:
            self.mark(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.mark(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def flow_text(parts: list[str | int]) -> str:
    """Text with single spaces; of breaks that follow each other the strongest stays."""
    out: list[str] = []
    pending, space = 0, False
    for part in parts:
        if isinstance(part, int):
            pending = max(pending, part)
            continue
        words = part.split()
        if not words:
            space = space or bool(part)
            continue
        if out:
            out.append("\n" * pending if pending else " " if space or part[:1].isspace() else "")
        out.append(" ".join(words))
        pending, space = 0, part[-1:].isspace()
    return "".join(out).replace("\x00", "").strip()


def html_to_text(source: str | None) -> str:
    """Readable text of a description. Source whose tags are themselves escaped, as a whole, is unescaped once."""
    if not source or not source.strip():
        return ""
    if "<" not in source and "&lt;" in source:
        source = html.unescape(source)
    flow = _Flow()
    flow.feed(source)
    flow.close()
    return flow_text(flow.parts)


# Patterns of a description's text. They have to find what the classifier's rules were written for, so they are
# kept as they are: acronyms and abbreviations with full stops, tags that part lines, ends of sentences, and words after which
# a line goes on.
ACRONYM = re.compile(r"\bu\.s\.a\.?|\bu\.\s?s\.?|\bu\.k\.?|\bu\.a\.e\.?", re.I | re.A)
ABBREVIATION = re.compile(r"\b(?:excl|incl|approx|etc|e\.g|i\.e)\.", re.I | re.A)
BLOCK = re.compile(r"</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section)\b[^>]*>", re.I | re.A)
TAG = re.compile(r"<[^>]*>", re.S)
SPACES = re.compile("[ \t\r\f\v\xa0]+")
SENTENCE_END = re.compile(r"[.!?;](?:[ \t\r\f]+|\n)")
DANGLING = re.compile(r"\b(?:in|within|from|of|to|the|at|and|or|following|located|based|residing|resident|reside|live|living|one of|except|excluding)\Z", re.I | re.A)
#: Lines that are joined to the one before, at most, and bytes of a line's end that are looked at.
JOINS, LINE_END = 2, 24


def without_stops(text: str) -> str:
    """Acronyms in capitals and abbreviations, without the full stops that would end a sentence."""
    if "." not in text:
        return text
    text = ABBREVIATION.sub(lambda m: m[0].replace(".", ""), text)
    return ACRONYM.sub(lambda m: re.sub("[. ]", "", m[0]).upper(), text)


def plain_text(source: str | None) -> str:
    """The classifier's view of a description: lines without markup, each with something in it."""
    text = without_stops(source or "")
    if not {"<", "&"}.isdisjoint(text):
        text = html.unescape(TAG.sub(" ", BLOCK.sub("\n", text)))
    return "\n".join(filter(None, map(str.strip, SPACES.sub(" ", text).split("\n"))))


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Sentences of each line, and whether one breaks off at its line's end rather than being ended by a mark."""
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if k + 1 < len(lines):
            line += "\n"
        *ended, rest = SENTENCE_END.split(line)
        yield from ((x, False) for x in map(str.strip, ended) if x)
        if rest.strip():
            yield rest.strip(), True


def sentences(text: str) -> list[str]:
    """Sentences and lines; a line that breaks off within a phrase goes on in the next."""
    out: list[str] = []
    joined, breaks_off = 0, False
    for piece, breaks in pieces(text):
        if breaks_off and joined < JOINS and DANGLING.search(out[-1].encode()[-LINE_END:].decode(errors="ignore")):
            out[-1] += f" {piece}"
            joined += 1
        else:
            out.append(piece)
            joined = 0
        breaks_off = breaks
    return out


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.h1 = url, "", ""
        self.meta: dict[str, str] = {}
        self.links: list[tuple[str, str]] = []
        self.scripts: list[str] = []
        self.stack: list[tuple[str, list]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and name not in self.meta:
                self.meta[name] = a.get("content", "").strip()
        elif tag in ("title", "h1", "a"):
            self.stack.append((tag, [a.get("href"), []]))
        elif tag == "script":
            self.stack.append((tag, [a.get("type", "").lower(), []]))

    def handle_data(self, data):
        for _, held in self.stack:
            held[1].append(data)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None:
            return
        _, (extra, texts) = self.stack.pop(at)
        text = " ".join("".join(texts).split())
        if tag == "title":
            self.title = self.title or text
        elif tag == "h1":
            self.h1 = self.h1 or text
        elif tag == "a" and extra is not None:
            self.links.append((urljoin(self.url, extra.strip()), text))
        elif tag == "script" and extra == "application/ld+json":
            self.scripts.append("".join(texts))


def job_postings(script: str) -> list[dict]:
    """JobPosting objects of a JSON-LD script: alone, in lists or in a graph, up to four levels deep."""
    try:
        root = json.loads(script)
    except ValueError:
        return []
    out: list[dict] = []

    def walk(x, depth: int) -> None:
        if depth > 4:
            return
        if isinstance(x, list):
            for y in x:
                walk(y, depth + 1)
        elif isinstance(x, dict):
            kinds = x.get("@type")
            if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]):
                out.append(x)
            if "@graph" in x:
                walk(x["@graph"], depth + 1)

    walk(root, 0)
    return out


def text_of(x) -> str:
    return x.strip() if isinstance(x, str) else str(x) if isinstance(x, int) else text_of(x[0]) if isinstance(x, list) and x else ""


def posting_row(p: dict) -> dict:
    places = p.get("jobLocation")
    names = []
    for place in places if isinstance(places, list) else [places]:
        address = place.get("address") if isinstance(place, dict) else None
        if isinstance(address, str):
            names.append(address.strip())
        elif isinstance(address, dict):
            country = address.get("addressCountry")
            parts = [text_of(address.get(k)) for k in ("addressLocality", "addressRegion")] + [text_of(country.get("name") if isinstance(country, dict) else country)]
            names.append(", ".join(x for x in parts if x))
    return {"title": text_of(p.get("title")), "description": text_of(p.get("description")), "date_posted": text_of(p.get("datePosted")), "valid_through": text_of(p.get("validThrough")), "employment_type": text_of(p.get("employmentType")), "location": "; ".join(n for n in names if n)}


PAGE_SCHEMA = "struct<title:string,h1:string,meta:map<string,string>,links:array<struct<url:string,text:string>>,postings:array<struct<title:string,description:string,date_posted:string,valid_through:string,employment_type:string,location:string>>>"


def parse_page(url: str | None, source: str | None) -> dict:
    page = _Page(url or "")
    page.feed(source or "")
    page.close()
    return {"title": page.title, "h1": page.h1, "meta": page.meta, "links": [{"url": u, "text": t} for u, t in page.links], "postings": [posting_row(p) for s in page.scripts for p in job_postings(s)]}


class _Main(_Flow):
    """The flow of each element that may hold the main text, without what stands around it."""

    def __init__(self):
        super().__init__()
        self.open: list[str] = []
        self.found: dict[str, list] = {}

    def active(self) -> list[list]:
        if self.hidden or any(t in CHROME for t in self.open):
            return []
        return [self.found[t] for t in MAIN if t in self.open]

    def handle_starttag(self, tag, attrs):
        if tag in MAIN and tag not in self.found:
            self.found[tag] = []
            self.open.append(tag)
        elif tag in CHROME:
            self.open.append(tag)
        self.spread(super().handle_starttag, tag, attrs)

    def handle_endtag(self, tag):
        self.spread(super().handle_endtag, tag)
        if tag in self.open:
            self.open.reverse()
            self.open.remove(tag)
            self.open.reverse()

    def handle_startendtag(self, tag, attrs):
        self.spread(super().handle_startendtag, tag, attrs)

    def handle_data(self, data):
        self.spread(super().handle_data, data)

    def spread(self, f: Callable, *args) -> None:
        self.parts = []
        f(*args)
        for flow in self.active():
            flow.extend(self.parts)


def main_text(source: str | None) -> str:
    """The text of the first main, article or body element, without navigation, footers and asides; of all without one."""
    page = _Main()
    page.feed(source or "")
    page.close()
    for tag in MAIN:
        if tag in page.found:
            return flow_text(page.found[tag])
    return html_to_text(source)


def _column(f: Callable[[str | None], object], kind: str) -> Callable[[Column], Column]:
    def apply(c: Column) -> Column:
        @F.pandas_udf(kind)
        def each(s: pd.Series) -> pd.Series:
            return s.map(f)

        return each(c)

    return apply


html_to_text_column = _column(html_to_text, "string")
plain_text_column = _column(plain_text, "string")
sentences_column = _column(lambda s: sentences(s or ""), "array<string>")
main_text_column = _column(main_text, "string")


def page_column(url: Column, source: Column) -> Column:
    """The page's title, first heading, first of each meta name, links and job postings."""

    @F.pandas_udf(PAGE_SCHEMA)
    def apply(u: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(a, b) for a, b in zip(u, s, strict=True)], columns=["title", "h1", "meta", "links", "postings"])

    return apply(url, source)
