"""Structured logs: one line an event, as JSON or as text."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone
from typing import IO

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


class Lines(logging.Formatter):
    def __init__(self, form: str):
        super().__init__()
        self.form = form

    def format(self, record: logging.LogRecord) -> str:
        names = {v: k for k, v in LEVELS.items()}
        stamp = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds")
        fields = {"time": stamp, "level": names.get(record.levelno, "info").upper(), "msg": record.getMessage(), **getattr(record, "fields", {})}
        if self.form == "json":
            return json.dumps(fields, ensure_ascii=False, default=str)
        quoted = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, str) and (not v or any(c in v for c in ' "=\n')) else v
        return " ".join(f"{k}={quoted(v)}" for k, v in fields.items())


def logger(level: str, form: str, to: IO[str]) -> logging.Logger:
    """A logger of its own; fields go in as extra={"fields": {...}}."""
    handler = logging.StreamHandler(to)
    handler.setFormatter(Lines(form))
    out = logging.Logger("postloom", LEVELS[level])
    out.addHandler(handler)
    return out
