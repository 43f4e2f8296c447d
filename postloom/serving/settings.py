"""Settings from the environment. All that is wrong is told at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import timedelta
from urllib.parse import urlsplit

UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}


def duration(text: str) -> timedelta:
    """"1h30m", "15s", "250ms"."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError("a duration such as 15s or 1h30m")
    return timedelta(seconds=sum(float(n) * UNITS[u] for n, u in parts))


def _number(least: int, most: int) -> Callable[[str], int]:
    def read(text: str) -> int:
        if not re.fullmatch(r"[+-]?\d+", text) or not least <= int(text) <= most:
            raise ValueError(f"a whole number from {least} to {most}")
        return int(text)

    return read


def _one_of(*values: str) -> Callable[[str], str]:
    def read(text: str) -> str:
        if text not in values:
            raise ValueError(f"one of {', '.join(values)}")
        return text

    return read


def _positive(text: str) -> timedelta:
    out = duration(text)
    if out <= timedelta():
        raise ValueError("a duration above 0")
    return out


def _origin(text: str) -> str:
    parts = urlsplit(text)
    if text != "*" and (parts.scheme not in ("http", "https") or not parts.netloc or parts.path.strip("/")):
        raise ValueError("an origin such as https://jobs.example")
    return text


def _address(text: str) -> tuple[str, int]:
    host, colon, port = text.rpartition(":")
    if not colon or not port.isdigit() or int(port) > 65535:
        raise ValueError("an address such as :8080")
    return host, int(port)


@dataclass(frozen=True)
class Settings:
    """warehouse is where the tables are; source answers are read from folders, so that network settings are left out."""

    warehouse: str
    environment: str = "development"
    log_level: str = "info"
    log_format: str = "json"
    shutdown_timeout: timedelta = timedelta(seconds=15)
    repository: str = "warehouse"
    search_budget: int = 60
    address: tuple[str, int] = ("", 8080)
    origin: str = "http://localhost:5173"
    max_age_days: int = 15
    profile: str = ""
    cities: str = ""


#: Variable, field, reader. Empty values count as not given.
VARIABLES = (
    ("WAREHOUSE", "warehouse", str),
    ("APP_ENV", "environment", _one_of("development", "staging", "production")),
    ("LOG_LEVEL", "log_level", _one_of("debug", "info", "warn", "error")),
    ("LOG_FORMAT", "log_format", _one_of("json", "text")),
    ("SHUTDOWN_TIMEOUT", "shutdown_timeout", _positive),
    ("JOB_REPOSITORY", "repository", _one_of("warehouse", "fixtures")),
    ("SEARCH_MAX_QUERIES_PER_RUN", "search_budget", _number(1, 100_000)),
    ("API_ADDR", "address", _address),
    ("CORS_ALLOWED_ORIGIN", "origin", _origin),
    ("JOB_MAX_AGE_DAYS", "max_age_days", _number(0, 3650)),
    ("RELEVANCE_PROFILE", "profile", str),
    ("CITIES", "cities", str),
)


def load(environment: Mapping[str, str]) -> Settings:
    """Settings from environment variables; ValueError tells every variable that is wrong."""
    found, wrong = {}, []
    for variable, name, read in VARIABLES:
        value = environment.get(variable, "")
        if value:
            try:
                found[name] = read(value)
            except ValueError as e:
                wrong.append(f"{variable} must be {e} (got {value!r})")
    if "warehouse" not in found and found.get("repository") != "fixtures":
        wrong.append("WAREHOUSE is missing")
    if wrong:
        raise ValueError("; ".join(wrong))
    return Settings(**{"warehouse": ""} | found)
