"""Text, page and collection operators over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import bucketing as B
from plinth.operators import pages as G
from plinth.operators import text_checks as T
from plinth.session import spread
from workload.registry import ORACLES, query
from workload.tables import LISTINGS, listings, table

PARS = r"""WITH pars AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS par, parts[i] AS text FROM
    (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS t(i)),
words AS (SELECT doc_id, par, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_''’ʻ]+') AS w FROM pars)"""
# Phrases that do occur in the given texts stand in for the stock phrases of one language.
PHRASES = ["de la", "und der", "the ", "para el"]


def pars(spark, sf):
    return T.paragraphs(spread(table(spark, sf, "documents")))


@query("txt_06_banned_phrases", sql=PARS + """
SELECT doc_id, par, phrase FROM pars, (VALUES ('de la'), ('und der'), ('the '), ('para el')) AS p(phrase)
WHERE contains(lower(text), phrase)""")
def banned(spark, sf):
    return T.phrase_hits(pars(spark, sf), PHRASES)


@query("txt_07_long_paragraphs", sql=PARS + """
SELECT doc_id, par, CAST(length(trim(text)) AS INT) AS chars FROM pars WHERE length(trim(text)) > 700""")
def long_paragraphs(spark, sf):
    return T.too_long(pars(spark, sf))


@query("txt_08_shared_openings", sql=PARS + """,
o AS (SELECT doc_id, par, array_to_string(w[1:3], ' ') AS opening FROM words WHERE len(w) > 0),
f AS (SELECT opening, arg_min(doc_id, (doc_id, par)) AS first_doc, arg_min(par, (doc_id, par)) AS first_par FROM o GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, par, opening, first_doc, first_par FROM o JOIN f USING (opening) WHERE doc_id <> first_doc OR par <> first_par""")
def openings(spark, sf):
    return T.shared_openings(pars(spark, sf))


@query("txt_09_shingle_repeats", sql=PARS + """,
r AS (SELECT doc_id, par, i AS pos, array_to_string(w[i:i + 5], ' ') AS run FROM words, unnest(generate_series(1, len(w) - 5)) AS t(i)),
f AS (SELECT run, arg_min(doc_id, (doc_id, par)) AS first_doc, arg_min(par, (doc_id, par)) AS first_par FROM r GROUP BY 1),
h AS (SELECT doc_id, par, pos, run, first_doc, first_par FROM r JOIN f USING (run) WHERE doc_id <> first_doc OR par <> first_par)
SELECT doc_id, par, arg_min(run, pos) AS run, arg_min(first_doc, pos) AS first_doc, arg_min(first_par, pos) AS first_par FROM h GROUP BY 1, 2""")
def shingles(spark, sf):
    return T.repeated_runs(pars(spark, sf))


@query("txt_10_notation_residue", sql=PARS + r"""
SELECT doc_id, par, 'notation' AS code, mark FROM pars, (VALUES ('so''m/m²'), ('USD/m²'), ('m²/oy'), ('%'), ('Δ')) AS m(mark) WHERE contains(text, mark)
UNION ALL SELECT doc_id, par, 'token', '[[' FROM pars WHERE regexp_matches(text, '\[\[F?\d*\]?\]?')""")
def notation(spark, sf):
    return T.notation_hits(pars(spark, sf))


ANALYTIC = " OR ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in T.ANALYTICAL)
FLAT = rf"""regexp_matches(text, '\d') AND NOT ({ANALYTIC})
  AND len(list_filter(regexp_split_to_array(text, '[.!?]+\s+'), lambda s: trim(s) <> '')) <= 2"""


@query("txt_11_flat_paragraphs", sql=PARS + f" SELECT doc_id, par FROM pars WHERE {FLAT}")
def flat(spark, sf):
    return T.flat_paragraphs(pars(spark, sf))


@query("agg_26_issue_counts", sql=PARS + f"""
SELECT 'long' AS code, count(*) AS n FROM pars WHERE length(trim(text)) > 700
UNION ALL SELECT 'flat', count(*) FROM pars WHERE {FLAT}""")
def issue_counts(spark, sf):
    p = pars(spark, sf)
    tagged = T.too_long(p).select(F.lit("long").alias("code")).unionByName(T.flat_paragraphs(p).select(F.lit("flat").alias("code")))
    return T.issue_counts(tagged)


@query("rpt_13_rewritable_issues", sql=PARS + f"""
SELECT doc_id, par, 'long' AS code, count(*) AS n FROM pars WHERE length(trim(text)) > 700 GROUP BY 1, 2
UNION ALL SELECT doc_id, par, 'flat', count(*) FROM pars WHERE {FLAT} GROUP BY 1, 2""")
def rewritable(spark, sf):
    p = pars(spark, sf)
    tagged = T.too_long(p).select("doc_id", "par", F.lit("long").alias("code")) \
        .unionByName(T.flat_paragraphs(p).select("doc_id", "par", F.lit("flat").alias("code"))) \
        .unionByName(p.where("trim(text) = ''").select("doc_id", "par", F.lit("empty").alias("code")))
    return T.rewritable(tagged)


# Every check, each in the SQL of its own query.
ISSUES = "(" + " UNION ALL ".join(f"SELECT doc_id, par, {code} AS code FROM ({sql})" for code, sql in [
    ("'empty'", PARS + " SELECT doc_id, par FROM pars WHERE trim(text) = ''"), ("'phrase'", ORACLES["txt_06_banned_phrases"]),
    ("'long'", ORACLES["txt_07_long_paragraphs"]), ("'opening'", ORACLES["txt_08_shared_openings"]),
    ("'repeat'", ORACLES["txt_09_shingle_repeats"]), ("code", ORACLES["txt_10_notation_residue"]),
    ("'flat'", ORACLES["txt_11_flat_paragraphs"])]) + ") AS issues"


@query("agg_26_issue_counts_all", sql=f"SELECT code, count(*) AS n FROM {ISSUES} GROUP BY 1")
def issue_counts_all(spark, sf):
    """All seven checks; ``agg_26_issue_counts`` runs two of them."""
    return T.issue_counts(T.issues(pars(spark, sf), PHRASES, details=False))


@query("rpt_13_rewritable_issues_all", sql=f"""
SELECT doc_id, par, code, count(*) AS n FROM {ISSUES} WHERE code IN ('phrase', 'repeat', 'opening', 'long', 'flat', 'notation') GROUP BY 1, 2, 3""")
def rewritable_all(spark, sf):
    """All seven checks; ``rpt_13_rewritable_issues`` runs two of them."""
    return T.rewritable(T.issues(pars(spark, sf), PHRASES, details=False))


@query("txt_12_fact_masking", sql=r"""
WITH f AS (SELECT doc_id, regexp_extract_all(text,
  '\d{4}-yil\s+\d{1,2}-(?:yanvar|fevral|mart|aprel|may|iyun|iyul|avgust|sentabr|oktabr|noyabr|dekabr)\w*|\d{4}-yil\s+(?:IV|III|II|I)\s+chora[gqk]\w*|[+-]?\d+(?:[  ]\d{3})*(?:,\d+)?%?') AS v FROM documents)
SELECT doc_id, '[[F' || (i - 1) || ']]' AS ref, v[i] AS value FROM f, unnest(generate_series(1, len(v))) AS t(i)""")
def masking(spark, sf):
    return T.facts(table(spark, sf, "documents"), ["doc_id"])


@query("txt_12_masked_text")
def masked_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.masked("text").alias("text"))


@query("txt_13_fact_guard", sql=r"""
WITH n AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[+-]?\d+(?:[  ]\d{3})*(?:,\d+)?%?')) AS v FROM conversations),
p AS (SELECT a.conv_id, a.turn, list_filter(a.v, lambda x: NOT list_contains(u.v, x)) AS bad FROM n a JOIN n u
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')
SELECT conv_id, turn, len(bad) AS unsupported_numbers, len(bad) = 0 AS supported FROM p""")
def guard(spark, sf):
    pairs = T.turns_with_source(table(spark, sf, "conversations"))
    return T.unsupported_numbers(pairs).select("conv_id", "turn", F.size("unsupported").cast("bigint").alias("unsupported_numbers"), "supported")


@query("txt_13_fact_guard_paragraphs", sql=PARS + r""",
n AS (SELECT doc_id, par, list_distinct(regexp_extract_all(text, '[+-]?\d+(?:[  ]\d{3})*(?:,\d+)?%?')) AS v FROM pars)
SELECT a.doc_id, a.par, len(list_filter(a.v, lambda x: NOT list_contains(u.v, x))) AS unsupported_numbers,
  len(list_filter(a.v, lambda x: NOT list_contains(u.v, x))) = 0 AS supported
FROM n a JOIN n u ON a.doc_id = u.doc_id AND a.par = u.par + 1 WHERE len(a.v) > 0""")
def guard_paragraphs(spark, sf):
    """Every number of a paragraph must already stand in the paragraph before it."""
    p = pars(spark, sf)
    before = p.select("doc_id", (F.col("par") + 1).alias("par"), F.col("text").alias("source"))
    pairs = p.where(F.size(T.numbers("text")) > 0).withColumnRenamed("text", "answer").join(before, ["doc_id", "par"])
    return T.unsupported_numbers(pairs).select("doc_id", "par", F.size("unsupported").cast("bigint").alias("unsupported_numbers"), "supported")


@query("txt_14_json_payload")
def json_payload(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.concat(
        F.lit("Here it is: "), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .otherwise(F.col("props")), F.lit(" as asked.")).alias("text"))
    return events.select("event_id", T.json_payload("text").alias("payload"))


@query("txt_15_blank_sections", sql=PARS + """
SELECT doc_id, count(*) AS blocks FROM pars GROUP BY 1 HAVING bool_and(length(text) < 400 OR trim(text) = '')""")
def blank_sections(spark, sf):
    """Paragraphs too short to carry a block count as blank here, so that blank sections occur."""
    blanked = pars(spark, sf).withColumn("text", F.when(F.char_length("text") < 400, " ").otherwise(F.col("text")))
    return T.blank_sections(blanked)


@query("flt_01_events_in_window", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderstatus = 'O' AS still_in_force FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' OR (o_orderdate < DATE '1997-01-01' AND o_orderstatus = 'O')""")
def in_window(spark, sf):
    events = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"),
                                               (F.col("o_orderstatus") == "O").alias("still_in_force"))
    return T.events_in_window(events, "1997-01-01", "1997-12-31")


# ---- pages ------------------------------------------------------------------

@query("txt_01_embedded_listings")
def embedded(spark, sf):
    """Offers planted as JSON in the pages' own scripts, in all of the carried forms."""
    offer = F.to_json(F.struct(F.col("page_id").alias("id"), F.array(F.struct(F.lit("price").alias("key"))).alias("params"),
                               F.struct(F.col("url").alias("city")).alias("location"), F.lit("t").alias("title")))
    listed = F.concat(F.lit('{"offers":['), offer, F.lit("]}"))
    state = F.concat(F.lit("window.__PRERENDERED_STATE__ = "), listed, F.lit(";"))
    quoted = F.concat(F.lit("var s = JSON.parse("), F.concat(F.lit('"'), F.replace(listed, F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit(");"))
    script = F.when(F.col("page_id") % 3 == 0, listed).when(F.col("page_id") % 3 == 1, state).otherwise(quoted)
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<script>"), script, F.lit("</script>"), F.col("html")).alias("html"))
    return G.embedded_offers(pages).select("id", "page_id", "title")


@query("txt_02_card_ids", sql=r"""
WITH h AS (SELECT page_id, list_distinct(list_filter(list_transform(regexp_extract_all(html || ' data-id="00' || page_id || '" data-id="0"', '(?i)\bdata-id\s*=\s*["'']([0-9]+)["'']', 1),
  lambda x: regexp_replace(x, '^0+', '')), lambda x: x <> '')) AS ids FROM pages)
SELECT page_id, len(ids) AS n, list_min(ids) AS first_id FROM h""")
def card_ids(spark, sf):
    html = F.concat("html", F.lit(' data-id="00'), F.col("page_id").cast("string"), F.lit('" data-id="0"'))
    ids = G.card_ids(html)
    return table(spark, sf, "pages").select("page_id", F.size(ids).cast("bigint").alias("n"), F.array_min(ids).alias("first_id"))


@query("txt_02_link_targets", sql=r"""
SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']([^"'']+)["'']', 1))) AS links FROM pages""")
def links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(G.link_targets("html")).cast("bigint").alias("links"))


def _text_sql():
    html = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in G.DROPPED_TAGS:
        html = rf"regexp_replace({html}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    sql = f"WITH a AS (SELECT page_id, {html} AS page FROM pages), b AS (SELECT page_id, coalesce("
    sql += ", ".join(rf"nullif(regexp_extract(page, '(?is)<{t}\b[^>]*>(.*?)</{t}\s*>', 1), '')" for t in ("article", "main", "body"))
    sql += ", page) AS body FROM a)"
    text = r"regexp_replace(body, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return sql + rf" SELECT page_id, trim(regexp_replace({text}, '\s+', ' ', 'g')) AS text FROM b"


@query("txt_03_readable_text", sql=_text_sql())
def readable(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", G.readable_text().alias("text"))


@query("txt_04_domain", sql=r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\.', '') AS domain FROM pages""")
def domains(spark, sf):
    return table(spark, sf, "pages").select("page_id", G.domain("url").alias("domain"))


TRUST = {"example.com": 0.7, "example.org": 0.55, "stat.uz": 1.0}


@query("txt_05_source_score", doubles="score", sql=r"""
WITH d AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\.', '') AS host, url AS title, lower(url || ' ' || html) AS t FROM pages)
SELECT page_id, least(2.0, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 0.7
  WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 0.55 ELSE 0.3 END
  + CASE WHEN contains(t, 'housing') THEN 0.12 ELSE 0 END + CASE WHEN contains(t, 'mortgage') THEN 0.12 ELSE 0 END
  + CASE WHEN contains(t, 'uzbekistan') THEN 0.25 ELSE 0 END + CASE WHEN contains(t, 'tashkent') THEN 0.06 ELSE 0 END
  + CASE WHEN contains(title, '2026') THEN 0.2 ELSE 0 END + CASE WHEN contains(title, '2025') THEN 0.15 ELSE 0 END
  + CASE WHEN contains(title, '2024') THEN 0.08 ELSE 0 END) AS score FROM d""")
def score(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", G.source_score(G.domain("url"), F.col("url"), F.col("html"), TRUST).alias("score"))


@query("jn_15_path_rules", sql=r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) AS path FROM pages)
SELECT page_id, url FROM p WHERE NOT regexp_matches(path, '^/fr/') AND NOT regexp_matches(path, '^/.*page=2') AND NOT regexp_matches(path, '^/.*ref=y$')""")
def path_rules(spark, sf):
    return G.allowed_paths(table(spark, sf, "pages").select("page_id", "url"), ["/fr/*", "/*page=2", "/*ref=y$"])


@query("set_04_distinct_with_priority", doubles="score", sql=r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) * 1.0 AS score FROM pages)
SELECT page_id, host, score FROM h QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) = 1""")
def priority(spark, sf):
    from plinth.operators.sets import distinct_by_priority
    hits = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
                                            F.length("html").cast("double").alias("score"))
    return distinct_by_priority(hits, ["host"], "score")


@query("agg_24_category_vote", sql="""
SELECT o_custkey, count(*) AS votes, min(o_orderstatus) AS category FROM orders GROUP BY 1
HAVING count(*) >= 2 AND min(o_orderstatus) = max(o_orderstatus)""")
def vote(spark, sf):
    votes = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("category"))
    return G.verified_category(votes, ["o_custkey"]).select("o_custkey", "votes", "category")


# ---- capacity buckets --------------------------------------------------------

CAPACITY = 1050


@query("bkt_01_capacity_buckets")
def buckets(spark, sf):
    rows = listings(spark, sf).select("macro_region", "region", "segment", F.col("price_usd").alias("price"))
    return B.bucket_table(B.capacity_buckets(rows, ["macro_region", "region", "segment"], "price", CAPACITY), CAPACITY)


@query("bkt_02_collection_coverage", doubles="share_pct", sql="WITH " + LISTINGS + """
SELECT kind AS category, count(*) AS listings, count(DISTINCT region) AS queries, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM listings GROUP BY 1""")
def coverage(spark, sf):
    rows = listings(spark, sf).select(F.col("kind").alias("category"), F.col("region").alias("query"))
    return B.coverage(rows)
