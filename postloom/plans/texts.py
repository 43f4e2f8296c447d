"""Queries of the text operators: role families, HTML and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import html
from postloom.operators import relevance
from postloom.session import ship

QUERIES, ORACLES = {}, {}


def titles(spark, d):
    """Titles made of role words and part names."""
    p = spark.read.parquet(f"{d}/part.parquet")
    roles = ["Sales Engineer", "Software Engineer, Backend", "Données Data Entry machine learning", "SRE / DevOps", "C++ Developer", "Business Developer", "Help-Desk", "Accountant", "Data  Scientist", "Ingénieur full stack"]
    role = F.get(F.array(*map(F.lit, roles)), (F.col("p_partkey") % len(roles)).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), F.concat(role, F.lit(" - "), "p_name").alias("title")), roles


def role_relevance(spark, d):
    rows, _ = titles(spark, d)
    return relevance.classify(rows).select("id", "role_family", "relevant", "relevance_matched")


def role_sql() -> str:
    """The rules as one CASE over the padded words of a title."""
    profile = relevance.SOFTWARE
    roles = ["Sales Engineer", "Software Engineer, Backend", "Données Data Entry machine learning", "SRE / DevOps", "C++ Developer", "Business Developer", "Help-Desk", "Accountant", "Data  Scientist", "Ingénieur full stack"]
    has = lambda p: f"contains(w, ' {p} ')"
    fits = [f"({' OR '.join(map(has, r.any))})" + (f" AND NOT ({' OR '.join(map(has, r.never))})" if r.never else "") for r in profile.rules]
    family = "CASE " + " ".join(f"WHEN {f} THEN '{r.family}'" for f, r in zip(fits, profile.rules, strict=True)) + f" ELSE '{profile.default}' END"
    first = "CASE " + " ".join(f"WHEN {f} THEN CASE {' '.join(f'WHEN {has(p)} THEN {chr(39)}{p}{chr(39)}' for p in r.any)} END" for f, r in zip(fits, profile.rules, strict=True)) + " ELSE '' END"
    values = ", ".join(f"({k}, '{r}')" for k, r in enumerate(roles))
    return rf"""
WITH r(k, role) AS (VALUES {values}), t AS (SELECT p_partkey AS id, ' ' || trim(regexp_replace(strip_accents(lower(role || ' - ' || p_name)), '[^\p{{L}}\p{{Nd}}+#]+', ' ', 'g')) || ' ' AS w FROM part JOIN r ON p_partkey % {len(roles)} = k)
SELECT id, {family} AS role_family, {family} IN ({', '.join(f"'{f}'" for f in profile.relevant)}) AS relevant, {first} AS relevance_matched FROM t"""


def pages(spark, d):
    ship(spark)
    return spark.read.parquet(f"{d}/pages.parquet")


def html_to_text(spark, d):
    return pages(spark, d).select("page_id", html.html_to_text_column(F.col("html")).alias("text"))


def page_parts(spark, d):
    p = pages(spark, d).select("page_id", html.page_column(F.col("url"), F.col("html")).alias("p"))
    return p.select("page_id", "p.title", "p.h1", F.size("p.links").alias("n_links"), F.size("p.postings").alias("n_postings"))


def page_main_text(spark, d):
    return pages(spark, d).select("page_id", html.main_text_column(F.col("html")).alias("text"))


def page_links(spark, d):
    p = pages(spark, d).select("page_id", F.posexplode(html.page_column(F.col("url"), F.col("html"))["links"]).alias("place", "link"))
    return p.select("page_id", "place", "link.url", "link.text")


def plain_sentences(spark, d):
    p = pages(spark, d).select("page_id", F.posexplode(html.sentences_column(html.plain_text_column(F.col("html")))).alias("place", "sentence"))
    return p


QUERIES |= {"role_relevance": role_relevance, "html_to_text": html_to_text, "page_parts": page_parts, "page_main_text": page_main_text, "page_links": page_links, "plain_sentences": plain_sentences}
ORACLES["role_relevance"] = role_sql()
