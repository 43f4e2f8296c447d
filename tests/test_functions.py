from datetime import datetime

from pyspark.sql import functions as F

from postloom.functions import dates, html, names, places, text
from postloom.operators import relevance
from postloom.operators.relevance import Profile, Rule


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_names(spark):
    assert values(spark, names.name_key, "Ethswitch S.C.", "EthSwitch", "Chaka Gebeya", "Gebeya Inc.", "Inc", "P.L.C", "ሰላም", "X Co Ltd") == ["ethswitch", "ethswitch", "chaka-gebeya", "gebeya", "inc", "plc", "", "x"]
    assert values(spark, names.title_key, "C# Developer", "C++  developer!", "አማርኛ - Job") == ["c# developer", "c++ developer", "አማርኛ job"]
    assert values(spark, names.is_placeholder_employer, "Confidential", "a@b.c", "ሰላም", "--", "Real Firm", "N/A") == [True, True, False, True, False, True]


def test_places(spark):
    assert values(spark, places.city_key, "Addis", "Ethiopia", None, " Hawassa , Ethiopia") == ["addis ababa", "", "", "hawassa"]
    pairs = [("Addis Ababa", "addis abeba, Ethiopia", True), ("", "Addis Ababa", True), ("Ethiopia", "Nairobi, Kenya", False), ("Hawassa", "Adama", False), ("", "", True), ("Hawassa", "", False), ("Hawassa, Ethiopia", "", True)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", places.same_place(F.col("a"), F.col("b")).alias("got")).collect())
    assert values(spark, places.strip_flags, "🇺🇸 USA 🇨🇦") == ["USA"]
    assert values(spark, lambda c: places.result_location(F.lit(""), c), "Work at Chapa in Ethiopia. Full-time", "at X in Adis ….", "nothing") == ["Ethiopia", "", ""]


def test_dates(spark):
    utc = datetime
    assert values(spark, dates.parse_date, "2026-09-01T10:00:00Z", "2026-09-01 10:00:00", "Mon, 5 Feb 2024 10:00:00 +0300", "2026-09-01", "soon", "") == [utc(2026, 9, 1, 10), utc(2026, 9, 1, 10), utc(2024, 2, 5, 7), utc(2026, 9, 1), None, None]
    now = F.lit(utc(2026, 9, 20)).cast("timestamp")
    assert values(spark, lambda c: dates.relative_date(c, now), "3 days ago", "1 Month ago", "99999999999 years ago", "Sep 14, 2026", "x") == [utc(2026, 9, 17), utc(2026, 8, 21), None, utc(2026, 9, 14), None]
    assert values(spark, lambda c: dates.posted_from_id(c.cast("bigint")), "4437765344") == [utc(2026, 7, 7, 8, 16, 27)]


def test_ages_over_a_century_are_no_dates(spark):
    now = F.lit(datetime(2026, 9, 20)).cast("timestamp")
    assert values(spark, lambda c: dates.relative_date(c, now), "36500 days ago", "36501 days ago", "999999 days ago", "52560000 minutes ago", "52560001 minutes ago", "100 years ago", "101 years ago") == [datetime(1926, 10, 15), None, None, datetime(1926, 10, 15), None, datetime(1926, 10, 15), None]


def test_relative_dates_of_large_keys_are_those_of_its_sql(spark, tmp_path):
    import duckdb

    from postloom.plans import scalars

    keys = [0, 1, 2, 3, 36496, 36497, 36498, 36499, 36500, 36501, 36504, 73000, 73004, 120_000, 1_199_996, 1_199_999, 52_559_997, 52_560_001, 105_120_001, 105_120_002]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    got = scalars.QUERIES["relative_dates"](spark, str(tmp_path)).select("id", F.unix_micros("at")).orderBy("id").collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        want = db.execute(f'SELECT id, epoch_us("at") FROM ({scalars.ORACLES["relative_dates"]}) ORDER BY id').fetchall()
    assert [tuple(r) for r in got] == want and len(want) == len(keys)


def test_text(spark):
    assert values(spark, text.clean_text, " \ta\u0000b  ", None) == ["ab", None]
    assert values(spark, lambda c: text.truncate(c, 2), "😀😀😀") == ["😀😀"]


def test_html_to_text():
    f = html.html_to_text
    assert f("<p>One</p><p>Two <b>bold</b>, un<em>believable</em></p><ul><li>a</li><li>b</li></ul>x") == "One\n\nTwo bold, unbelievable\n\na\nb\nx"
    assert f("<strong>Note</strong>: x") == "Note: x"
    assert f("&lt;p&gt;A&lt;/p&gt;&lt;p&gt;B&lt;/p&gt;") == "A\n\nB"
    assert f("<p>&lt;b&gt; shown</p>") == "<b> shown"
    assert f("<style>p{}</style>a<script>if (a<b) x()</script>b<br><br/>c") == "ab\nc"
    assert f("<table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table>") == "1 2\n3"
    assert f(" \n ") == "" and f(None) == ""


def test_plain_text_and_sentences():
    assert html.plain_text("<div>In the U.S. and U.K.</div><p>excl. Africa&nbsp; now</p>") == "In the US and UK\nexcl Africa now"
    assert html.sentences("Must be located in\nthe US. Remote; yes\nok!") == ["Must be located in the US", "Remote", "yes", "ok!"]


PAGE = """<html><head><title> A  job </title><meta property="og:title" content="First"><meta property="og:title" content="Second">
<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "Dev", "jobLocation": {"address": {"addressLocality": "Addis Ababa", "addressCountry": {"name": "Ethiopia"}}}}]}</script></head>
<body><nav>Menu</nav><h1>Head <i>line</i></h1><main>Text <aside>ad</aside><p>more</p></main><a href="/jobs/1">Dev <b>role</b></a><footer>end</footer></body></html>"""


def test_pages(spark):
    page = html.parse_page("https://x.example/list/", PAGE)
    assert page["title"] == "A job" and page["h1"] == "Head line" and page["meta"] == {"og:title": "First"}
    assert page["links"] == [{"url": "https://x.example/jobs/1", "text": "Dev role"}]
    assert [(p["title"], p["location"]) for p in page["postings"]] == [("Dev", "Addis Ababa, Ethiopia")]
    assert html.main_text(PAGE) == "Text\n\nmore"
    assert html.main_text("<p>only</p>") == "only"
    df = spark.createDataFrame([("https://x.example/", PAGE), (None, None)], "url string, html string")
    out = df.select(html.page_column(F.col("url"), F.col("html")).alias("p"), html.main_text_column(F.col("html")).alias("t")).collect()
    assert out[0].p.h1 == "Head line" and out[0].t == "Text\n\nmore" and out[1].p.links == []


def brute(profile, title):
    padded = f" {relevance.words(title)} "
    for rule in profile.rules:
        hits = [p for p in rule.any if f" {p} " in padded]
        if hits and not any(f" {p} " in padded for p in rule.never):
            return rule.family, rule.family in profile.relevant, hits[0]
    return profile.default, profile.default in profile.relevant, ""


def test_relevance(spark, tmp_path):
    titles = ["Senior Sales Engineer", "Software Engineer (Backend)", "Développeur / Developer", "C++ guru", "Engineering manager", "", None, "DATA ENTRY machine learning", "Ingénieur Full-Stack", "real estate developer", "SRE"]
    for profile in (relevance.SOFTWARE, Profile("x", (), (Rule("y", ("guru", "sre")),)), Profile("x", ("x",))):
        df = spark.createDataFrame([(t,) for t in titles], "title string")
        for r in relevance.classify(df, profile).collect():
            assert (r.role_family, r.relevant, r.relevance_matched) == brute(profile, r.title or "")
    path = tmp_path / "p.json"
    path.write_text('{"default": "o", "relevant": ["s"], "rules": [{"family": "s", "any": ["Front-End"], "not": ["x"]}]}')
    assert Profile.load(str(path)).rules == (Rule("s", ("front end",), ("x",)),)


def test_lists_in_json(spark):
    from postloom.functions import text as t

    cases = ['["a", "b"]', "[]", None, "", "{}", "[1", '["a", null]', '"x"']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i")
    assert [r[0] for r in df.select(t.string_list(F.col("c"))).collect()] == [["a", "b"], [], [], [], [], [], [], []]
    cases = ['[{"field": "title", "text": "x"}, {"text": "y", "more": 1}]', "[]", None, "no", "{}"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i")
    assert [[tuple(e) for e in r[0]] for r in df.select(t.evidence_list(F.col("c"))).collect()] == [[("title", "x"), ("", "y")], [], [], [], []]


def test_rfc3339_and_named_cities(spark):
    from postloom.functions import dates
    from postloom.operators.ingest import has_named_city

    row = spark.sql("SELECT TIMESTAMP '2026-03-04 05:06:07' AS t, CAST(NULL AS TIMESTAMP) AS n").select(dates.rfc3339(F.col("t")).alias("t"), dates.rfc3339(F.col("n")).alias("n")).first()
    assert (row.t, row.n) == ("2026-03-04T05:06:07Z", None)
    places = spark.createDataFrame([("Adama, Ethiopia",), ("Ethiopia",), (None,), ("Remote",)], "location_raw string")
    assert "Adama, Ethiopia" in {r[0] for r in has_named_city(places).collect()} and None not in {r[0] for r in has_named_city(places).collect()}


def test_role_families(spark):
    cases = {
        "Lead Backend Engineer": "software_engineering", "Rust Engineer": "software_engineering", "CTO": "software_engineering", "Site Reliability Lead": "devops_security", "IAM Engineer": "devops_security",
        "Staff Software Engineer, Machine Learning": "data_ml", "Machine Learning Architect, Python": "software_engineering", "Developer Advocate": "other_tech", "Site Engineer": "other_tech", "UX Lead": "product_design",
        "IT Support Agent": "it_support", "Recruiter, Software Engineers": "non_tech", "Business Developer": "non_tech", "Widget Engineer": "non_tech", "Ingénieur Backend": "software_engineering", "": "non_tech", "Asrea Clerk": "non_tech",
    }
    df = spark.createDataFrame([(t,) for t in cases], "title string")
    got = {r.title: (r.role_family, r.relevant) for r in relevance.classify(df).collect()}
    assert got == {t: (f, f in ("software_engineering", "data_ml", "devops_security")) for t, f in cases.items()}
    assert sum(len(r.any) + len(r.never) for r in relevance.SOFTWARE.rules) <= 200
