"""GET /api/v1/jobs and /api/v1/jobs/{id} as JSON. Answers are made by a plain function; the server only carries them."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import Row

from postloom.operators.listing import JobsRepository, parse_filter
from postloom.serving.settings import Settings

JOBS = "/api/v1/jobs"


def stamp(t: datetime | None) -> str:
    return "" if t is None else t.replace(tzinfo=timezone.utc).isoformat().replace("+00:00", "Z")


def role(r: dict) -> dict | None:
    return None if r.get("role_family") is None else {"family": r["role_family"], "relevant": bool(r.get("relevant"))}


def verdict(e: Row | None, whole: bool) -> dict | None:
    if e is None:
        return None
    e = e.asDict(True)
    out = {"status": e["status"], "confidence": e["confidence"], "basis": e["basis"], "restrictions": e["restrictions"] or [], "hours_constraint": e["hours_constraint"] or None}
    if whole:
        out |= {"reasons": e["reasons"] or [], "evidence": e["evidence"] or [], "locations": e.get("detected_locations") or [], "classifier_version": e.get("classifier_version")}
    return out


def posting(r: Row, whole: bool = False) -> dict:
    d = r.asDict()
    out = {
        "id": str(r.id), "title": r.title, "company_name": r.company, "company_logo_url": None, "is_priority": bool(r.is_priority), "market": r.market, "source": r.source, "remote_type": r.remote_type,
        "employment_type": r.employment_type, "region_note": r.location_raw or "", "tags": d.get("tags") or [], "posted_at": stamp(r.posted_at), "application_url": r.application_url or "",
        "eligibility": verdict(r.eligibility, whole), "role": role(d),
    }
    return out | {"description": r.description or ""} if whole else out


def answer(repository: JobsRepository, method: str, target: str, now: datetime, max_age_days: int = 0) -> tuple[int, dict | None]:
    """Status and body. Bad parameters are 400, unknown postings and paths 404, other methods 405."""
    url = urlsplit(target)
    path = unquote(url.path)
    if method == "OPTIONS":
        return 204, None
    if path != JOBS and not path.startswith(f"{JOBS}/"):
        return 404, {"error": "not found"}
    if method != "GET":
        return 405, {"error": "method not allowed"}
    if path != JOBS:
        found = repository.get(path.removeprefix(f"{JOBS}/"), now).limit(1).collect()
        return (200, posting(found[0], whole=True)) if found else (404, {"error": "job not found"})
    try:
        f = parse_filter({k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()})
    except ValueError as e:
        return 400, {"error": str(e)}
    f.max_age_seconds = max_age_days * 86400
    rows = repository.list(f, now).collect()  # one page
    total = rows[0].total if rows else repository.total(f, now).first().total
    return 200, {"jobs": [posting(r) for r in rows], "page": f.page, "page_size": f.page_size, "total": total}


def server(repository: JobsRepository, settings: Settings, log: logging.Logger, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        timeout = 5  # for a request's head

        def respond(self) -> None:
            began = time.perf_counter()
            try:
                status, body = answer(repository, self.command, self.path, clock(), settings.max_age_days)
            except Exception:
                log.exception("a request failed")
                status, body = 500, {"error": "internal error"}
            sent = b"" if body is None else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            headers = {"Access-Control-Allow-Origin": settings.origin, "Vary": "Origin", "Access-Control-Allow-Methods": "GET, OPTIONS", "Access-Control-Allow-Headers": "Content-Type"}
            for name, value in (headers | {"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(sent))}).items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(sent)
            log.info("api request", extra={"fields": {"method": self.command, "path": urlsplit(self.path).path, "status": status, "duration_ms": round((time.perf_counter() - began) * 1000)}})

        do_GET = do_OPTIONS = do_POST = do_PUT = do_DELETE = respond

        def log_message(self, *_) -> None:
            """Requests are logged above."""

    return ThreadingHTTPServer(settings.address, Handler)
