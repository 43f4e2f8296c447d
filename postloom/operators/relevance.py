"""Role families of job titles by ordered phrase rules, as native expressions."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A title is of the family if a phrase of any stands in it as whole words and none of never does."""

    family: str
    any: tuple[str, ...]
    never: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    """Rules in order, the first that fits decides; the family of other titles; the families that are wanted."""

    default: str
    relevant: tuple[str, ...]
    rules: tuple[Rule, ...] = field(default=())

    @staticmethod
    def load(path: str) -> Profile:
        """A profile file: default, relevant, rules of family, any and not. Unknown keys are errors."""
        raw = json.loads(Path(path).read_text())
        if extra := set(raw) - {"default", "relevant", "rules"}:
            raise ValueError(f"unknown keys: {sorted(extra)}")
        if not str(raw.get("default", "")).strip():
            raise ValueError("a profile needs a default family")
        rules = []
        for k, r in enumerate(raw.get("rules", [])):
            if set(r) - {"family", "any", "not"} or not str(r.get("family", "")).strip() or not r.get("any"):
                raise ValueError(f"rule {k} needs a family and phrases")
            rule = Rule(r["family"], tuple(map(words, r["any"])), tuple(w for w in map(words, r.get("not", [])) if w))
            if "" in rule.any:
                raise ValueError(f"rule {k} has an empty phrase")
            rules.append(rule)
        return Profile(raw["default"], tuple(raw.get("relevant", ())), tuple(rules))


def words(s: str) -> str:
    """Words in lower case without accents, with one space between; + and # are letters here."""
    plain = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    plain = unicodedata.normalize("NFC", plain).lower()
    return " ".join("".join(c if c in "+#" or c.isalpha() or unicodedata.category(c) == "Nd" else " " for c in plain).split())


# Families and the phrases that tell them, in the order in which they decide. These are the commonest; a profile
# with more is a file (Profile.load).
SOFTWARE = Profile(
    "non_tech",
    ("software_engineering", "data_ml", "devops_security"),
    (
        Rule("other_tech", (
            "sales engineer", "solutions engineer", "solution engineer", "solutions architect", "solution architect", "presales", "customer engineer", "field engineer", "developer advocate", "developer relations",
            "technical program manager", "technical account manager", "technical writer", "hardware engineer", "electrical engineer", "mechanical engineer", "civil engineer", "chemical engineer", "manufacturing engineer",
            "process engineer", "industrial engineer", "structural engineer", "annotator", "ai trainer", "data annotation", "salesforce", "servicenow", "instructor", "teacher", "tutor", "tester", "site engineer", "power engineer",
            "pcb", "layout engineer", "field deploy", "services engineer", "value engineer", "electronics engineer", "project engineer", "technical sales", "technician",
        )),
        Rule("non_tech", ("safety engineer", "safety officer", "environmental engineer", "recruiter", "talent acquisition", "account executive", "account manager", "customer success", "sales representative", "marketing manager", "people operations")),
        Rule("it_support", ("technical support engineer", "support engineer", "it support", "service desk", "help desk", "helpdesk", "desktop support", "it specialist", "it administrator", "technical support", "product support")),
        Rule("product_design", (
            "product manager", "product management", "product owner", "head of product", "director of product", "vp of product", "product designer", "ux designer", "ui designer", "ux", "user experience", "graphic designer",
            "visual designer", "designer", "user researcher", "product design",
        )),
        Rule("devops_security", (
            "sre", "site reliability", "reliability engineer", "devops", "dev ops", "platform engineer", "infrastructure engineer", "cloud engineer", "cloud architect", "systems engineer", "system engineer", "systems administrator",
            "system administrator", "linux administrator", "network engineer", "security engineer", "security analyst", "security architect", "appsec", "application security", "cybersecurity", "cyber security",
            "information security", "penetration tester", "pentester", "devsecops", "release engineer", "build engineer", "kubernetes", "iam",
        )),
        Rule("data_ml", (
            "data engineer", "data engineering", "data scientist", "data science", "machine learning", "ml engineer", "mlops", "ai engineer", "ai researcher", "applied scientist", "analytics engineer", "research scientist",
            "research engineer", "deep learning", "computer vision", "nlp engineer", "llm", "data platform", "big data", "database engineer",
        ), ("architect",)),
        Rule("software_engineering", (
            "software engineer", "software developer", "developer", "programmer", "backend", "back end", "frontend", "front end", "full stack", "fullstack", "mobile engineer", "ios engineer", "android engineer", "sdet", "qa engineer",
            "test engineer", "automation engineer", "embedded", "firmware", "engineering manager", "manager engineering", "director of engineering", "vp of engineering", "head of engineering", "cto", "staff engineer",
            "principal engineer", "tech lead", "technical lead", "software architect", "senior engineer", "mobile architect", "kernel", "web engineer", "java", "python", "golang", "rust", "c++", "c#", "ruby", "php", "react", "typescript",
            "javascript", "kotlin", "swift", "scala", "android", "ios", "software engineering", "distinguished engineer", "payments engineer", "performance engineer",
        ), ("business developer", "property developer", "developer community", "community", "developer marketing", "business development", "sales developer", "real estate developer")),
    ),
)


def _accents() -> tuple[str, str]:
    """Letters that are a base letter with marks, and the base letters."""
    found = []
    for c in map(chr, range(0xC0, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if plain != c and len(plain) == 1 and c.isalpha():
            found.append((c, plain))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


ACCENTED, BARE = _accents()


def title_words(title: Column) -> Column:
    """words() as an expression, for scripts whose accented letters lie below U+2000."""
    plain = F.lower(F.translate(F.regexp_replace(F.coalesce(title, F.lit("")), r"\p{Mn}+", ""), ACCENTED, BARE))
    return F.btrim(F.regexp_replace(plain, r"[^\p{L}\p{Nd}+#]+", " "))


def classify(rows: DataFrame, profile: Profile = SOFTWARE, title: str = "title") -> DataFrame:
    """rows with role_family, relevant and relevance_matched (the phrase that decided; '' for the default)."""
    padded = F.concat(F.lit(" "), title_words(F.col(title)), F.lit(" "))
    first = lambda phrases: F.get(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.col("_padded").contains(F.concat(F.lit(" "), p, F.lit(" ")))), 0)
    hit = F.lit(None).cast("struct<family:string,matched:string>")
    for rule in reversed(profile.rules):
        found = first(rule.any)
        fits = found.isNotNull() if not rule.never else found.isNotNull() & first(rule.never).isNull()
        hit = F.when(fits, F.struct(F.lit(rule.family).alias("family"), found.alias("matched"))).otherwise(hit)
    out = rows.withColumn("_padded", padded).withColumn("_hit", hit).withColumn("role_family", F.coalesce("_hit.family", F.lit(profile.default)))
    relevant = F.col("role_family").isin(*profile.relevant) if profile.relevant else F.lit(False)
    return out.withColumn("relevant", relevant).withColumn("relevance_matched", F.coalesce("_hit.matched", F.lit(""))).drop("_padded", "_hit")
