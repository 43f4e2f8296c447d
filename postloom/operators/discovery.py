"""Finding a company's own board: slugs to try, and what proves that a board is the company's. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.names import CORPORATE, name_key, slug, title_key
from postloom.functions.text import trim_space

MOST_SLUGS, SAMPLE = 4, 8
# Suffixes of names that are written like domains.
ENDINGS = (".com", ".io", ".ai", ".dev", ".co", ".app", ".net", ".org", ".so", ".sh")
# Words under which firms trade and that texts use anyway, so finding one says little.
COMMON_WORDS = (
    "arc", "axiom", "boundary", "bubble", "calm", "census", "close", "coda", "cursor", "daily", "element", "expo", "front", "gem", "ghost", "glitch", "guru", "harvest", "heap", "hex", "hired", "hopin", "jam", "kit",
    "knock", "loom", "loops", "matrix", "medium", "mercury", "modal", "neon", "nomad", "orb", "oxide", "pitch", "polar", "pulse", "railway", "relay", "remote", "render", "resend", "rive", "sanity", "segment", "signal",
    "split", "temporal", "terminal", "vault", "warp", "wise",
)
# Openings found nearly everywhere, which link nobody to anybody.
GENERIC_TITLES = (
    "software engineer", "senior software engineer", "staff software engineer", "principal software engineer", "backend engineer", "frontend engineer", "full stack engineer", "fullstack engineer", "data engineer",
    "devops engineer", "site reliability engineer", "engineering manager", "product manager", "senior product manager", "product designer", "designer", "data scientist", "data analyst", "account executive",
    "sales development representative", "customer success manager", "customer support", "support engineer", "recruiter", "office manager", "marketing manager", "content writer", "technical writer", "security engineer", "qa engineer",
)


# How each provider writes the address of a board, and names in that place that are no boards.
BOARD_URLS = (
    ("greenhouse", r"(?i)^https?://(?:boards|job-boards)\.greenhouse\.io/([a-zA-Z0-9_-]+)(?:[/?#]|$)"),
    ("lever", r"(?i)^https?://jobs\.lever\.co/([a-zA-Z0-9_-]+)(?:[/?#]|$)"),
    ("ashby", r"(?i)^https?://jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)(?:[/?#]|$)"),
)
NO_BOARDS = {"greenhouse": ("embed",)}
BOARD_SITES = ("boards.greenhouse.io", "job-boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com")


def strip_ending(name: Column) -> Column:
    """The name without one web-address ending, unless it is nothing else."""
    plain = trim_space(name)
    cut = F.regexp_replace(plain, f"(?i)({'|'.join(e.replace('.', '[.]') for e in ENDINGS)})$", "")
    return F.when(cut == "", plain).otherwise(trim_space(cut))


def slug_variants(name: Column) -> Column:
    """At most MOST_SLUGS slugs under which a board may be found, likeliest first; none for names in other scripts."""
    dash, key, stripped = slug(F.replace(name, F.lit("."), F.lit(""))), name_key(name), slug(strip_ending(name))
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    more = F.when(strip_ending(name) != trim_space(name), F.array(bare(stripped), stripped)).otherwise(F.array().cast("array<string>"))
    tried = F.concat(F.array(bare(dash), dash, bare(key), key), more)
    found = F.slice(F.array_distinct(F.filter(F.transform(tried, lambda s: F.btrim(s, F.lit("-"))), lambda s: s != "")), 1, MOST_SLUGS)
    return F.when(name.rlike(r"[\p{L}&&[^\p{ASCII}]]"), F.array().cast("array<string>")).otherwise(found)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def is_common_name(name: Column) -> Column:
    words = tokens(strip_ending(name))
    return (F.size(words) > 0) & F.forall(words, lambda t: t.isin(*COMMON_WORDS))


def names_match(ours: Column, board: Column) -> Column:
    """Equal name keys; a web-address ending is dropped from the board's name only, and only if ours has none."""
    key = name_key(ours)
    return (key != "") & ((key == name_key(board)) | ((strip_ending(ours) == trim_space(ours)) & (key == name_key(strip_ending(board)))))


def shares_word(ours: Column, board: Column) -> Column:
    """A common word besides corporate ones, or one name inside the other without spaces."""
    own, other = (F.filter(tokens(c), lambda t: ~t.isin(*CORPORATE)) for c in (ours, strip_ending(board)))
    a, b = F.array_join(own, ""), F.array_join(other, "")
    return ((a != "") & (b != "") & (a.contains(b) | b.contains(a))) | F.arrays_overlap(own, other)


def opening_key(title: Column) -> Column:
    """A title's key without bracketed notes and a trailing word for anywhere."""
    key = title_key(F.regexp_replace(title, r"[(\[][^()\[\]]*[)\]]", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(key, " remote$", ""), " worldwide$", ""), " global$", "")


def board_query(name: Column) -> Column:
    """A web search for a company's board: its name as a phrase, on the providers' sites."""
    plain = F.regexp_replace(F.replace(name, F.lit('"'), F.lit("")), r"[\r\n]", " ")
    return F.concat(F.lit('"'), plain, F.lit(f'" ({" OR ".join(f"site:{s}" for s in BOARD_SITES)})'))


def board_of(url: Column) -> Column:
    """struct(ats_provider, external_board_id) of a board's address; null for any other."""
    out = F.lit(None).cast("struct<ats_provider:string,external_board_id:string>")
    for provider, pattern in reversed(BOARD_URLS):
        found = F.regexp_extract(url, pattern, 1)
        fits = (found != "") & ~F.lower(found).isin(*NO_BOARDS.get(provider, ("",)))
        out = F.when(fits, F.struct(F.lit(provider).alias("ats_provider"), found.alias("external_board_id"))).otherwise(out)
    return out


def boards_found(results: DataFrame) -> DataFrame:
    """One row per company of results (company_name, rank, url): its best-ranked board, or none with problem "no board found"."""
    seen = results.withColumn("_board", board_of(F.col("url")))
    hit = F.when(F.col("_board").isNotNull(), F.col("rank"))
    best = seen.groupBy("company_name").agg(F.min_by(F.struct("_board", "url"), hit).alias("b"))
    return best.select("company_name", F.col("b._board.ats_provider").alias("ats_provider"), F.col("b._board.external_board_id").alias("external_board_id"), F.col("b.url").alias("board_url"), F.when(F.col("b").isNull(), "no board found").alias("problem"))


def candidate_problem() -> Column:
    """Why a candidate (company_name, ats_provider, external_board_id, board_url) cannot be registered; null if it can."""
    out = F.lit(None).cast("string")
    out = F.when(F.coalesce(F.try_parse_url("board_url", F.lit("HOST")), F.lit("")) == "", "board_url has no host").otherwise(out)
    out = F.when(~F.coalesce(F.lower(F.regexp_extract("board_url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False)), "board_url is not http").otherwise(out)
    for name in ("external_board_id", "ats_provider", "company_name"):
        out = F.when(F.coalesce(trim_space(F.col(name)), F.lit("")) == "", f"{name} is missing").otherwise(out)
    return out


def checked_candidates(candidates: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (with verified) to register, with discovery_metadata, and those refused, with problem.

    probes: (board_url, method, status, at), what the boards' pages answered to HEAD and GET; GET counts where HEAD failed. A
    verified candidate was proven by the provider's own interface and needs no probe.
    """
    ok = F.col("status").between(200, 299)
    best = probes.groupBy(F.col("board_url").alias("_url")).agg(F.min_by(F.struct("method", "status", "at"), F.when(ok, F.col("method") == "GET")).alias("ok"), F.max_by("status", "method").alias("last"))
    j = candidates.withColumn("_problem", candidate_problem()).join(best, F.col("board_url") == F.col("_url"), "left")
    proven = F.coalesce(F.col("verified"), F.lit(False))
    problem = F.coalesce("_problem", F.when(~proven & F.col("ok").isNull(), F.concat(F.lit("the board's page answered "), F.coalesce(F.col("last").cast("string"), F.lit("nothing")))))
    stamp = F.date_format(F.col("ok.at"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    by_probe = F.create_map(F.lit("validation_method"), F.col("ok.method"), F.lit("status_code"), F.col("ok.status").cast("string"), F.lit("validated_at"), stamp)
    by_proof = F.create_map(F.lit("validation_method"), F.lit("verified-by-api"), F.lit("status_code"), F.lit("0"), F.lit("source"), F.lit("discover-boards"))
    j = j.withColumn("problem", problem).withColumn("discovery_metadata", F.when(proven, by_proof).otherwise(by_probe))
    return j.where("problem is null").select(*candidates.columns, "discovery_metadata"), j.where("problem is not null").select(*candidates.columns, "problem")


def mentions(text: Column, name: Column) -> Column:
    """Whether the text has the name as whole words. A name whose words have a capital at the start only ("Ramp") counts as
    written; one with capitals inside, or in one case, counts in any."""
    split = lambda c: F.filter(F.split(c, r"[^\p{L}\p{Nd}]+"), lambda t: t != "")
    padded = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    own = split(name)
    any_case = F.exists(own, lambda t: F.substring(t, 2, 1_000_000).rlike(r"\p{Lu}") | (t == F.lower(t)) | (t == F.upper(t)))
    exact = padded(split(text)).contains(padded(own))
    folded = F.lower(padded(split(text))).contains(F.lower(padded(own)))
    return (F.size(own) > 0) & F.when(any_case, folded).otherwise(exact)


def has_domain(text: Column, domain: Column) -> Column:
    """Whether the text has the domain with no letter, digit, dash or underscore beside it."""
    parts = F.split(F.lower(text), F.concat(F.lit(r"\Q"), domain, F.lit(r"\E")))
    sides = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.struct(F.get(parts, k - 1).alias("a"), F.get(parts, k).alias("b")))
    free = lambda s: s["b"].isNotNull() & ~s["a"].rlike(r"[\p{L}\p{Nd}_-]$") & ~s["b"].rlike(r"^[\p{L}\p{Nd}_-]")
    return F.coalesce((domain != "") & F.exists(sides, free), F.lit(False))


def board_verdicts(boards: DataFrame, jobs: DataFrame, known_titles: DataFrame) -> DataFrame:
    """One row per board (board_id, name, domain): verdict, listed and name_hits.

    jobs: (board_id, ord, title, text). A board without postings is empty; one whose sampled texts name the domain is proven;
    one of which at least half name the company is owned, or uncorroborated when titles are known for the company (name,
    title) and none but generic ones are shared; all others are foreign.
    """
    placed = jobs.withColumn("_place", F.row_number().over(Window.partitionBy("board_id").orderBy("ord")))
    named = placed.join(F.broadcast(boards.select("board_id", "name", "domain")) if boards.count() <= 100_000 else boards.select("board_id", "name", "domain"), "board_id")
    sampled = F.col("_place") <= SAMPLE
    has_name = mentions(F.col("text"), F.col("name"))
    by_domain = has_domain(F.col("text"), F.lower(F.coalesce("domain", F.lit(""))))
    sums = named.groupBy("board_id").agg(F.count(F.lit(1)).alias("listed"), F.count_if(sampled).alias("sampled"), F.count_if(sampled & has_name).alias("name_hits"), F.bool_or(sampled & by_domain).alias("by_domain"))
    wanted = known_titles.select("name", opening_key(F.col("title")).alias("_key")).where("_key <> ''").distinct()
    listed = named.select("board_id", "name", opening_key(F.col("title")).alias("_key")).where(~F.col("_key").isin(*GENERIC_TITLES)).distinct()
    shared = listed.join(wanted, ["name", "_key"]).select("board_id").distinct().withColumn("shares", F.lit(True))
    knows = wanted.select("name").distinct().withColumn("knows", F.lit(True))
    all_ = boards.join(sums, "board_id", "left").join(shared, "board_id", "left").join(knows, "name", "left")
    by_name = (F.col("listed") >= 2) & ~is_common_name(F.col("name")) & (F.col("name_hits") * 2 >= F.col("sampled"))
    verdict = F.when(F.col("listed").isNull(), "empty").when(F.col("by_domain"), "proven").when(by_name & F.coalesce("knows", F.lit(False)) & F.col("shares").isNull(), "uncorroborated").when(by_name, "owned").otherwise("foreign")
    return all_.select("board_id", "name", verdict.alias("verdict"), F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("name_hits", F.lit(0)).alias("name_hits"))


def choose(verdicts: DataFrame) -> DataFrame:
    """One row per company: its accepted boards, and whether they are ambiguous (several, not all proven by domain)."""
    good = verdicts.where(F.col("verdict").isin("proven", "owned"))
    return good.groupBy("name").agg(F.array_sort(F.collect_set("board_id")).alias("boards"), ((F.count(F.lit(1)) > 1) & ~F.bool_and(F.col("verdict") == "proven")).alias("ambiguous"))


def boards_to_retire(registered: DataFrame, verified: DataFrame, refused: DataFrame, unchecked: DataFrame) -> DataFrame:
    """Registered boards (name, board_id) that were checked and refused, and neither verified nor left unchecked by name."""
    return registered.join(refused.select("board_id"), "board_id", "left_semi").join(verified.select("board_id"), "board_id", "left_anti").join(unchecked.select("name"), "name", "left_anti")
