"""Web pages: embedded listings, card ids, readable text, domains, scores, path rules."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import cut_lineage

# Trust weights, keyword and year bonuses, dropped tags.
TRUSTED = {
    "stat.uz": 1.0, "cbu.uz": 1.0, "lex.uz": 1.0, "gov.uz": 0.9, "president.uz": 0.9, "mineconomy.uz": 0.9, "imf.org": 0.9,
    "worldbank.org": 0.9, "adb.org": 0.85, "ebrd.com": 0.85, "un.org": 0.8, "oecd.org": 0.8, "gazeta.uz": 0.7, "kun.uz": 0.65,
    "spot.uz": 0.65, "review.uz": 0.6, "uza.uz": 0.6, "podrobno.uz": 0.55, "reuters.com": 0.7, "fitchratings.com": 0.7,
    "moodys.com": 0.7, "trend.az": 0.5,
}
KEYWORDS = {
    "uzbekistan": 0.25, "узбекистан": 0.25, "o'zbekiston": 0.25, "housing": 0.12, "mortgage": 0.12, "real estate": 0.1,
    "жиль": 0.12, "ипотек": 0.12, "недвижим": 0.1, "uy-joy": 0.12, "ipoteka": 0.12, "tashkent": 0.06, "ташкент": 0.06,
}
YEARS = {"2026": 0.2, "2025": 0.15, "2024": 0.08}
DROPPED_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "noscript"]
OFFER_SCHEMA = "id STRING, params ARRAY<STRING>, location STRING, title STRING, category STRING"


def domain(url) -> Column:
    """Host of a URL in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/]+)", 1)), r"^www\.", "")


def readable_text(html="html", max_chars: int | None = None) -> Column:
    """Text of the article (else main, else body, else all) without scripts, chrome and tags."""
    page = F.col(html) if isinstance(html, str) else html
    page = F.regexp_replace(page, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED_TAGS:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    body = page
    for tag in ("body", "main", "article"):
        part = F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
        body = F.when(part != "", part).otherwise(body)
    text = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(text, 1, max_chars) if max_chars else text


def source_score(host: Column, title: Column, snippet: Column, trusted: Mapping[str, float] = TRUSTED) -> Column:
    """Trust of the domain (0.3 when unknown) plus keyword and recency bonuses, at most 2."""
    score = F.lit(0.3)
    for name, weight in reversed(list(trusted.items())):
        match = (host == name) | host.endswith("." + name)
        score = F.when(match, F.greatest(F.lit(0.3), F.lit(weight))).otherwise(score)
    text = F.lower(F.concat_ws(" ", title, snippet))
    for word, bonus in KEYWORDS.items():
        score = score + F.when(F.contains(text, F.lit(word)), bonus).otherwise(0.0)
    for year, bonus in YEARS.items():
        score = score + F.when(F.contains(title, F.lit(year)), bonus).otherwise(0.0)
    return F.least(score, F.lit(2.0))


def card_ids(html="html", attribute: str = "data-id") -> Column:
    """Distinct positive decimal ids of the cards of a page, in order, without leading zeros."""
    raw = F.regexp_extract_all(html, F.lit(rf'(?i)\b{attribute}\s*=\s*["\']([0-9]+)["\']'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.regexp_replace(x, "^0+", "")), lambda x: x != ""))


def link_targets(html="html") -> Column:
    """Distinct href values of a page, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)\bhref\s*=\s*["\']([^"\']+)["\']'), F.lit(1)))


def embedded_offers(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Offer objects carried as JSON by the scripts of a page, one row per offer id.

    Plain JSON, ``JSON.parse("...")`` and an assigned state are read; an offer has an id, a
    params list and a location, and is found at any depth of a payload.
    """
    script = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1)))
    s = F.trim("s")
    quoted = F.concat(F.regexp_extract_all(s, F.lit(r'JSON\.parse\(\s*("(?:\\.|[^"\\])*")\s*\)'), F.lit(1)),
                      F.regexp_extract_all(s, F.lit(r'__PRERENDERED_STATE__\s*=\s*("(?:\\.|[^"\\])*")'), F.lit(1)))
    unescaped = F.transform(quoted, lambda q: F.try_variant_get(F.try_parse_json(q), "$", "string"))
    assigned = F.regexp_extract(s, r"(?s)__PRERENDERED_STATE__\s*=\s*(\{.*\})\s*;?\s*$", 1)
    payloads = F.filter(F.concat(F.array(s, assigned), unescaped), lambda p: p.rlike(r"^[\[{]"))
    docs = pages.select(key, script.alias("s")).select(key, F.explode(payloads).alias("p")) \
        .select(key, F.try_parse_json("p").alias("v")).where("v IS NOT NULL")
    level = cut_lineage(docs.select(F.col(key).alias("page"), "v"))
    found = []
    while not level.isEmpty():  # one round for each level of the deepest payload
        found.append(level.where(F.schema_of_variant("v").startswith("OBJECT")))
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).select("page", F.col("value").alias("v"))
        level = cut_lineage(inner.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
    objects = reduce(DataFrame.unionByName, found) if found else level
    offers = objects.select(F.col("page").alias(key), F.col("v").alias("o")).select(
        key, F.try_variant_get("o", "$.id", "string").alias("id"), F.try_variant_get("o", "$.title", "string").alias("title"),
        F.try_variant_get("o", "$.params", "ARRAY<VARIANT>").isNotNull().alias("has_params"),
        F.to_json(F.try_variant_get("o", "$.location", "variant")).alias("location"), F.to_json("o").alias("offer"))
    ok = offers.where("id IS NOT NULL AND has_params AND location IS NOT NULL")
    return ok.groupBy("id").agg(F.max_by(F.struct(key, "title", "offer"), F.col(key)).alias("r")).select("id", "r.*")


def rule_pattern(rule: str) -> str:
    """A path rule with * wildcards and an optional final $ as a regular expression."""
    body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
    return "^" + ".*".join(re.escape(part) for part in body.split("*")) + end


def allowed_paths(pages: DataFrame, rules: list[str], url: str = "url") -> DataFrame:
    """Pages whose path no rule disallows; the handful of rules becomes one predicate each."""
    path = F.regexp_extract(url, r"^https?://[^/]+(/.*)?$", 1)
    blocked = F.lit(False)
    for rule in rules:
        blocked = blocked | path.rlike(rule_pattern(rule))
    return pages.where(~blocked)


def verified_category(votes: DataFrame, keys: list[str], agreeing: int = 2) -> DataFrame:
    """A category is accepted when at least two votes were cast and all of them agree."""
    out = votes.where("category IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("votes"), F.min("category").alias("category"), F.max("category").alias("__b"))
    return out.where((F.col("votes") >= agreeing) & (F.col("category") == F.col("__b"))).drop("__b")
