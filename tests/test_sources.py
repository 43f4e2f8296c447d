import json
from datetime import datetime

import pytest

from postloom.sources import boards

NOW = datetime(2026, 9, 20)


def answers(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "body string")


def rows(df):
    return [r.asDict() for r in df.orderBy("ord").collect()]


def test_greenhouse(spark):
    jobs = [
        {"id": 7, "title": " Engineer\u0000 ", "absolute_url": "https://x/7", "location": {"name": "Leeds - Hybrid; Remote (UK)"}, "content": "&lt;p&gt;One&lt;/p&gt;&lt;p&gt;Two&lt;/p&gt;", "first_published": "2026-09-01T10:00:00-04:00"},
        {"title": "No id", "location": {"name": "Non-remote"}},
        "odd",
    ]
    a, b = rows(boards.greenhouse(answers(spark, {"jobs": jobs})))
    assert (a["external_id"], a["title"], a["description"], a["remote_type"], a["published_at"]) == ("7", "Engineer", "One\n\nTwo", "hybrid", datetime(2026, 9, 1, 14))
    assert (b["external_id"], b["remote_type"], b["published_at"]) == ("", "", None)
    assert rows(boards.greenhouse(answers(spark, {"jobs": []}))) == []
    with pytest.raises(Exception, match="no list of postings"):
        boards.greenhouse(answers(spark, {"error": 1})).collect()


def test_lever(spark):
    jobs = [{
        "id": " a ", "text": "Dev", "hostedUrl": "https://jobs.lever.co/x/a", "createdAt": 1767225600000, "workplaceType": "on-site", "categories": {"commitment": "Full-time", "location": "A", "allLocations": ["A", "B"]},
        "descriptionPlain": "Intro", "lists": [{"text": "Duties", "content": "<li>one</li><li>two</li>"}], "additionalPlain": "End",
    }, {"id": "b", "hostedUrl": "http://evil.example/", "categories": None}]
    a, b = rows(boards.lever(answers(spark, jobs)))
    assert (a["external_id"], a["location_raw"], a["remote_type"], a["employment_type"], a["published_at"]) == ("a", "A; B", "onsite", "full_time", datetime(2026, 1, 1))
    assert a["description"] == "Intro\n\nDuties\none\ntwo\n\nEnd"
    assert b["url"] == ""
    with pytest.raises(Exception, match="no list of postings"):
        boards.lever(answers(spark, {"ok": False})).collect()


def test_ashby(spark):
    jobs = [
        {"id": "1", "title": "A", "location": "X", "secondaryLocations": [{"location": " Y "}, {"location": ""}], "isRemote": True, "jobUrl": "https://jobs.ashbyhq.com/x/1", "descriptionHtml": "<b>Hi</b> you", "publishedAt": "2026-09-01T00:00:00.123Z"},
        {"id": "2", "isListed": False},
        {"id": "3", "workplaceType": "Hybrid", "isRemote": True, "employmentType": "Intern"},
    ]
    a, b = rows(boards.ashby(answers(spark, {"jobs": jobs})))
    assert (a["location_raw"], a["remote_type"], a["description"], a["url"]) == ("X; Y", "remote", "Hi you", "https://jobs.ashbyhq.com/x/1")
    assert (b["external_id"], b["remote_type"], b["employment_type"]) == ("3", "hybrid", "internship")


def remote(i, **more):
    return {"id": i, "url": f"https://remotive.com/{i}", "title": f"T{i}", "company_name": "Firm", "publication_date": "2026-09-10T00:00:00", "candidate_required_location": "USA , ", "description": "x"} | more


def test_remote_boards_judge(spark):
    jobs = [remote(1), remote(1, title="again"), remote(2, url="https://other.example"), remote(3, company_name="Confidential"), remote(4, publication_date="2026-01-01"), remote(5, publication_date="soon"), remote(6, publication_date=None)]
    out = boards.remotive(answers(spark, {"jobs": jobs}), NOW)
    assert [r["verdict"] for r in rows(out)] == ["kept", "kept", "invalid", "dropped", "dropped", "invalid", "kept"]
    good = rows(boards.kept(out))
    assert [(r["external_id"], r["title"], r["location_raw"], r["remote_type"]) for r in good] == [("1", "T1", "USA", "remote"), ("6", "T6", "USA", "remote")]
    with pytest.raises(ValueError, match="usable"):
        boards.kept(boards.remotive(answers(spark, {"jobs": [remote(5, publication_date="soon")]}), NOW))
    with pytest.raises(ValueError, match="no records"):
        boards.kept(boards.remotive(answers(spark, {"jobs": []}), NOW))


def test_other_boards(spark):
    job = {"id": 9, "url": "https://jobicy.com/9", "jobTitle": "T", "companyName": "F", "jobType": ["Contract", "x"], "jobGeo": "EMEA", "jobDescription": "<p>a</p>", "pubDate": "2026-09-19 10:00:00"}
    (a,) = rows(boards.jobicy(answers(spark, {"jobs": [job]}), NOW))
    assert (a["employment_type"], a["verdict"], a["external_id"]) == ("contract", "kept", "9")
    (b,) = rows(boards.jobicy(answers(spark, {"jobs": [job | {"jobType": "Part Time"}]}), NOW))
    assert b["employment_type"] == "part_time"
    ok = [{"legal": "terms"}, {"id": "1", "epoch": 1789000000, "company": "F", "position": "P", "url": "https://remoteok.com/1"}, {"id": "2", "date": "2026-09-15T00:00:00+00:00", "company": "F", "position": "P", "url": "https://remoteok.com/2"}]
    assert [r["verdict"] for r in rows(boards.remoteok(answers(spark, ok), NOW))] == ["kept", "kept"]
    (n,) = rows(boards.workingnomads(answers(spark, [{"url": "https://www.workingnomads.com/job/go/55/", "title": "T", "company_name": "F", "pub_date": "2026-09-12T00:00:00-04:00"}]), NOW))
    assert (n["external_id"], n["verdict"]) == ("55", "kept")
    h = {"title": "T", "companyName": "F", "locationRestrictions": ["Kenya", "Ghana"], "pubDate": 1789500000, "expiryDate": 1799500000, "applicationLink": "https://himalayas.app/x", "guid": "g", "excerpt": "short"}
    a, b = rows(boards.himalayas(answers(spark, {"jobs": [h, h | {"locationRestrictions": "Kenya", "guid": "k", "expiryDate": 1789500001}]}), NOW))
    assert (a["location_raw"], a["description"], a["verdict"]) == ("Kenya, Ghana", "short", "kept")
    assert (b["location_raw"], b["verdict"]) == ("Kenya", "dropped")


def test_order_holds_for_any_number_of_answers_and_postings(spark):
    """Two thousand answers in as many partitions: places in an answer do not run into the next one's."""
    out = boards.records(spark.range(2000, numPartitions=2000).selectExpr("concat('{\"jobs\": [{\"id\": ', id * 2, '}, {\"id\": ', id * 2 + 1, '}]}') AS body"), "jobs", "id bigint")
    assert [r[0] for r in out.orderBy("ord").select("r.id").collect()] == list(range(4000))
