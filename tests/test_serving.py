import io
import json
import threading
import urllib.error
import urllib.request
from datetime import datetime, timedelta

import pytest

from postloom.serving import api, logs
from postloom.serving.commands import main
from postloom.serving.fixtures import ROWS, FixtureRepository
from postloom.serving.settings import Settings, duration, load

NOW = datetime(2026, 6, 20)


def test_settings():
    s = load({"WAREHOUSE": "/w", "API_ADDR": "0.0.0.0:90", "SHUTDOWN_TIMEOUT": "1m30s", "LOG_LEVEL": ""})
    assert (s.warehouse, s.address, s.shutdown_timeout, s.log_level, s.max_age_days) == ("/w", ("0.0.0.0", 90), timedelta(seconds=90), "info", 15)
    assert load({"JOB_REPOSITORY": "fixtures"}).warehouse == "" and duration("250ms") == timedelta(milliseconds=250)
    with pytest.raises(ValueError) as e:
        load({"APP_ENV": "x", "API_ADDR": "90", "JOB_MAX_AGE_DAYS": "-1", "CORS_ALLOWED_ORIGIN": "jobs", "SHUTDOWN_TIMEOUT": "0s", "LOG_FORMAT": "xml", "SEARCH_MAX_QUERIES_PER_RUN": "many"})
    assert all(n in str(e.value) for n in ("WAREHOUSE", "APP_ENV", "API_ADDR", "JOB_MAX_AGE_DAYS", "CORS_ALLOWED_ORIGIN", "SHUTDOWN_TIMEOUT", "LOG_FORMAT", "SEARCH_MAX_QUERIES_PER_RUN"))


def test_logs():
    out = io.StringIO()
    log = logs.logger("info", "json", out)
    log.debug("no")
    log.warning("slow", extra={"fields": {"path": "/x", "n": 3}})
    line = json.loads(out.getvalue())
    assert (line["level"], line["msg"], line["path"], line["n"]) == ("WARN", "slow", "/x", 3)
    out = io.StringIO()
    logs.logger("debug", "text", out).debug("a b", extra={"fields": {"k": "v"}})
    assert 'level=DEBUG msg="a b" k=v' in out.getvalue()


@pytest.fixture(scope="module")
def fixtures(spark):
    return FixtureRepository(spark)


def test_answers(fixtures):
    get = lambda target: api.answer(fixtures, "GET", target, NOW)
    status, body = get("/api/v1/jobs?page_size=3")
    assert status == 200 and body["total"] == len(ROWS) and [j["title"] for j in body["jobs"]] == ["Orchard keeper", "Data engineer", "Backend developer"]
    assert body["jobs"][0]["posted_at"] == "2026-06-12T00:00:00Z" and body["jobs"][0]["eligibility"] is None and body["jobs"][0]["role"] is None and "description" not in body["jobs"][0]
    assert {j["id"] for j in get("/api/v1/jobs?tag=MAPS")[1]["jobs"]} == {"9", "10"}
    assert {j["id"] for j in get("/api/v1/jobs?q=spark")[1]["jobs"]} == {"2", "3"} and get("/api/v1/jobs?q=mill&priority=true")[1]["total"] == 2
    assert get("/api/v1/jobs?employment_type=internship&remote_type=remote")[1]["total"] == 1 and get("/api/v1/jobs?market=ethiopia")[1] == {"jobs": [], "page": 1, "page_size": 20, "total": 0}
    assert get("/api/v1/jobs?page=9")[1]["total"] == len(ROWS)  # past the end
    status, body = get("/api/v1/jobs/4")
    assert status == 200 and (body["title"], body["description"]) == ("Night baker", "Night baker at Old Mill.")
    assert get("/api/v1/jobs/99")[0] == get("/api/v1/jobs/x")[0] == get("/")[0] == get("/api/v1/jobsx")[0] == 404
    status, body = get("/api/v1/jobs?remote_type=moon")
    assert status == 400 and "remote_type must be one of" in body["error"]
    assert api.answer(fixtures, "OPTIONS", "/api/v1/jobs", NOW) == (204, None) and api.answer(fixtures, "POST", "/api/v1/jobs", NOW)[0] == 405


def test_server(fixtures):
    out = io.StringIO()
    http = api.server(fixtures, Settings("", address=("127.0.0.1", 0), origin="https://jobs.example"), logs.logger("info", "json", out), lambda: NOW)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    try:
        with urllib.request.urlopen(f"{base}/api/v1/jobs?tag=bread", timeout=60) as r:
            assert r.headers["Access-Control-Allow-Origin"] == "https://jobs.example" and json.load(r)["jobs"][0]["title"] == "Night baker"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{base}/api/v1/jobs/77", timeout=60)
        assert e.value.code == 404
    finally:
        http.shutdown()
        http.server_close()
    assert [json.loads(x)["status"] for x in out.getvalue().splitlines()] == [200, 404]


def test_commands(spark, tmp_path, capsys):
    env = {"WAREHOUSE": str(tmp_path / "w"), "LOG_LEVEL": "error"}

    def run(*args, status=0):
        assert main(list(args), spark, env) == status
        out = capsys.readouterr().out.strip().split("\n")
        return json.loads(out[-1]) if not status else None

    assert main(["list"], spark, {}) == 2
    assert run("migrate-up") == {"version": 2} and run("migrate-down") == {"version": 1} and run("migrate-up") == {"version": 2}
    (tmp_path / "seeds.json").write_text(json.dumps([
        {"company_name": "Old Mill", "ats_provider": "greenhouse", "external_board_id": "oldmill", "board_url": "https://boards.greenhouse.io/oldmill", "verified": True},
        {"company_name": "Nowhere", "ats_provider": "lever", "external_board_id": "nowhere", "board_url": "https://jobs.lever.co/nowhere"},
    ]))
    assert run("discover", str(tmp_path / "seeds.json")) == {"registered": 1, "refused": 1}
    board = tmp_path / "answers" / "greenhouse"
    board.mkdir(parents=True)
    job = lambda k, place: {"id": k, "title": f"Baker {k}", "absolute_url": f"https://x.example/{k}", "location": {"name": place}, "content": "We bake bread.", "first_published": "2026-06-01T00:00:00Z"}
    (board / "oldmill.json").write_text(json.dumps({"jobs": [job(1, "Adama, Ethiopia"), job(2, "Remote - Canada")]}))
    (board / "unknown.json").write_text("{}")
    assert run("ingest", str(tmp_path / "answers")) == {"succeeded": 1, "failed": 1, "inserted": 2, "changed": 0, "unchanged": 0, "skipped": 0, "removed": 0, "all_failed": False}
    assert run("classify") == {"classified": 2, "eligible": 1, "ineligible": 1, "uncertain": 0, "failed": 0}
    assert run("classify")["classified"] == 0 and run("classify", "--force")["classified"] == 2
    assert run("list", "eligibility=eligible")["total"] == 1
    (board / "oldmill.json").write_text(json.dumps({"jobs": [job(1, "Adama, Ethiopia")]}))
    assert run("ingest", str(tmp_path / "answers"))["removed"] == 1 and run("list")["total"] == 1
    (board / "oldmill.json").write_text("[]")
    run("ingest", str(tmp_path / "answers"), status=1)  # nothing could be read, so nothing is closed
    assert run("list")["total"] == 1
    (tmp_path / "priority.json").write_text(json.dumps({"companies": [{"name": "Old Mill", "website": "https://mill.example"}, {"name": "Inn"}]}))
    assert run("seed-priority", str(tmp_path / "priority.json")) == {"companies": 2, "refused": 0}
    assert run("priority-report") == {"with_jobs": 1, "companies": 2, "missing": 0, "total_open": 1}
    (tmp_path / "found.json").write_text("\n".join(json.dumps({"company_name": "Larch", "rank": k, "url": u}) for k, u in enumerate(["https://larch.example", "https://jobs.lever.co/larch"])))
    (tmp_path / "probes.json").write_text(json.dumps({"board_url": "https://jobs.lever.co/larch", "method": "HEAD", "status": 200, "at": "2026-06-01T00:00:00Z"}))
    assert run("search-discover", str(tmp_path / "found.json"), "--probes", str(tmp_path / "probes.json")) == {"registered": 1, "refused": 0}
