"""Text clean-up, news, disclosures, deals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordered import top_per_group
from ..operators.round_robin import round_robin
from ..registry import query
from ..sources.tables import table


@query("html_text", f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {tx.html_text_sql('html')} AS t FROM pages)")
def html(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


CANON_SQL = r"""canon AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\.', '') AS domain,
 lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z]+://[^/?]+)', 1)) || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/+$', '') AS base,
 array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|gclid|fbclid|ref|source)(=|$)')), '&') AS q FROM pages),
urls AS (SELECT page_id, url, domain, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM canon)"""


def urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", "url", tx.domain(u).alias("domain"), tx.canonical_url(u).alias("canonical"))


@query("url_canonical", f"WITH {CANON_SQL} SELECT page_id, domain, canonical, left(sha256(canonical), 16) AS source_id FROM urls")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("page_id", "domain", "canonical", F.left(F.sha2(F.col("canonical").cast("binary"), 256), F.lit(16)).alias("source_id"))


@query("news_first_per_url", f"WITH {CANON_SQL} SELECT canonical, min(page_id) AS page_id, count(*) AS n FROM urls GROUP BY 1")
def first_per_url(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("news_round_robin", f"WITH {CANON_SQL}, f AS (SELECT domain, min(page_id) AS page_id FROM urls GROUP BY domain, canonical), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS position FROM f) SELECT domain, page_id, position FROM r ORDER BY position, domain LIMIT 30")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    """The first of each domain, then the second of each, and so on."""
    f = urls(spark, d).groupBy("domain", "canonical").agg(F.min("page_id").alias("page_id"))
    r = f.withColumn("position", F.row_number().over(Window.partitionBy("domain").orderBy("page_id")).cast("long"))
    return r.orderBy("position", "domain").limit(30).select("domain", "page_id", "position")


_FLAT_SQL = "trim(regexp_replace(replace(replace(text, chr(133), ' '), chr(160), ' '), '[\\t-\\r\\x1c-\\x20]+', ' ', 'g'), ' ')"
_SENTENCE_SQL = f"""c AS (SELECT doc_id, f, CASE WHEN length(f) <= {tx.CLIP} THEN f ELSE rtrim(regexp_replace(f[1:{tx.CLIP + 1}], ' [^ ]*$', ''), ' ,;:-') || '…' END AS t FROM (SELECT doc_id, {_FLAT_SQL} AS f FROM documents)),
p AS (SELECT doc_id, length(f) > {tx.CLIP} AS cut, list_filter(string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:{tx.LINES}] AS parts FROM c),
l AS (SELECT doc_id, cut, list_transform(parts, lambda x: CASE WHEN length(x) <= {tx.LINE} THEN x ELSE rtrim(regexp_replace(x[1:{tx.LINE + 1}], ' [^ ]*$', ''), ' ,;:-') || '…' END) AS ls FROM p)"""


@query("fallback_lines", f"""WITH {_SENTENCE_SQL} SELECT doc_id, cut, list_transform(ls, lambda x: CASE WHEN len(string_split(x, ' ')) <= {tx.LINE_WORDS} THEN x ELSE rtrim(array_to_string(string_split(x, ' ')[1:{tx.LINE_WORDS}], ' '), ' ,;:-.') || '…' END) AS lines FROM l""")
def fallback_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first three sentences of every document as lines of at most 24 words, and whether its text was clipped."""
    docs = table(spark, d, "documents")
    flat = F.btrim(F.regexp_replace("text", tx.SPACE, " "), F.lit(" "))
    return docs.select("doc_id", (F.length(flat) > tx.CLIP).alias("cut"), tx.first_sentences(F.col("text")).alias("lines"))


NEWS_SQL = f"""{CANON_SQL}, n AS (SELECT page_id, domain, canonical, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1), ''), 'other') AS topic,
 trim(regexp_replace(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS title FROM urls JOIN (SELECT page_id, html FROM pages) USING (page_id)),
o AS (SELECT *, row_number() OVER (ORDER BY position, topic) AS k FROM (SELECT n.*, row_number() OVER (PARTITION BY topic ORDER BY page_id) AS position FROM n)),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS taken, []::VARCHAR[] AS us, []::VARCHAR[] AS ds, []::VARCHAR[] AS ts UNION ALL
 SELECT o.k, CASE WHEN ok THEN page_id END, CASE WHEN ok THEN list_append(us, canonical) ELSE us END, CASE WHEN ok THEN list_append(ds, domain) ELSE ds END, CASE WHEN ok THEN list_append(ts, title) ELSE ts END
 FROM (SELECT g.us, g.ds, g.ts, o.*, NOT list_contains(us, canonical) AND NOT list_contains(ds, domain) AND (title = '' OR len(list_filter(ts, lambda t: t <> '' AND 1 - levenshtein(t, title) / greatest(length(t), length(title))::DOUBLE >= 0.88)) = 0) AS ok
 FROM g JOIN o ON o.k = g.k + 1) o)"""


@query("news_selection", f"WITH RECURSIVE {NEWS_SQL} SELECT page_id, topic, position FROM g JOIN o ON o.k = g.k WHERE taken IS NOT NULL ORDER BY o.k LIMIT 30")
def news_selection(spark: SparkSession, d: str) -> DataFrame:
    """Thirty pages interleaved from the topics of their urls: each url and domain once, no near copies of titles."""
    topic = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1), F.lit("")), F.lit("other"))
    title = tx.normal_title(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), topic.alias("group"), tx.canonical_url(F.col("url")).alias("url"), tx.domain(F.col("url")).alias("domain"), title.alias("title"))
    return round_robin(pages, [F.asc("id")], limit=30).select(F.col("id").alias("page_id"), F.col("group").alias("topic"), "position")


#: Terms of a section score and their weights.
TERMS = {"the": 2, "and": 1, "licensed": 3, "tion": 1}


@query("keyword_score", "SELECT doc_id, " + " + ".join(f"least(10, (length(t) - length(replace(t, '{k}', ''))) // {len(k)}) * {w}" for k, w in TERMS.items()) + " AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    score = F.lit(0).cast("long")
    for term, weight in TERMS.items():
        score = score + F.least(F.lit(10).cast("long"), tx.count_of(t, term)) * weight
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


@query("category_ladder", "SELECT doc_id, CASE WHEN regexp_matches(t, 'apache|licensed') THEN 'legal' WHEN regexp_matches(t, '[0-9]{13,}') THEN 'identifier' WHEN contains(t, '|') THEN 'table' ELSE 'prose' END AS category, md5(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'))) AS title_key FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def category(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    word = F.when(t.rlike("apache|licensed"), "legal").when(t.rlike("[0-9]{13,}"), "identifier").when(F.contains(t, F.lit("|")), "table").otherwise("prose")
    return table(spark, d, "documents").select("doc_id", word.alias("category"), F.md5(tx.normal_title(F.col("text"))).alias("title_key"))


@query("clip_words", r"SELECT doc_id, md5(array_to_string(w[1:24], ' ') || CASE WHEN len(w) > 24 THEN '…' ELSE '' END) AS clip FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM documents)")
def clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.first_words(F.col("text"), 24)).alias("clip"))


@query("distinct_evidence", "SELECT md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS k, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.md5(tx.normal_title(F.col("text")))
    return table(spark, d, "documents").groupBy(k.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("section_split_largest", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, sum(regexp_matches(line, '[A-Z]{4,}')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l), s AS (SELECT doc_id, section::BIGINT AS section, sum(length(line))::BIGINT AS n FROM h GROUP BY 1, 2)
SELECT doc_id, max(n) AS n, arg_max(section, (n, -section)) AS section FROM s WHERE n > 200 GROUP BY 1""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a run of capitals open a section; the longest section of over 200 characters wins."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    heading = F.col("line").rlike("[A-Z]{4,}").cast("long")
    h = lines.withColumn("section", F.sum(heading).over(Window.partitionBy("doc_id").orderBy("i")))
    s = h.groupBy("doc_id", "section").agg(F.sum(F.length("line")).alias("n")).where("n > 200")
    return s.groupBy("doc_id").agg(F.max("n").alias("m"), F.max_by("section", F.struct("n", -F.col("section"))).alias("section")).withColumnRenamed("m", "n")


@query("chunk_paragraphs", r"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS w FROM documents),
f AS (SELECT doc_id, list_reduce(w, lambda a, x: CASE WHEN a % 1000000 + x > 400 AND a % 1000000 > 0 THEN (a // 1000000 + 1) * 1000000 + x ELSE a + x END, 0::BIGINT) AS s FROM p) SELECT doc_id, s // 1000000 + 1 AS chunks FROM f""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy chunks of whole paragraphs: a paragraph that would pass the target opens the next chunk."""
    lens = F.transform(F.split("text", "\n"), lambda p: F.length(p).cast("long"))
    zero = F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("size"))

    def step(a, x):
        new = (a["size"] + x > 400) & (a["size"] > 0)
        return F.struct((a["n"] + new.cast("long")).alias("n"), (F.when(new, F.lit(0)).otherwise(a["size"]) + x).alias("size"))

    return table(spark, d, "documents").select("doc_id", F.aggregate(lens, zero, step, lambda a: a["n"]).alias("chunks"))


@query("amount_parse", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value * 1e5 WHEN 1 THEN value * 1e7 WHEN 2 THEN value * 1e6 ELSE value END AS amount FROM events""")
def amounts(spark: SparkSession, d: str) -> DataFrame:
    """Indian and other multipliers read from text such as '12.5 crore'."""
    k = F.col("event_id") % 4
    said = F.concat_ws(" ", F.col("value").cast("string"), F.when(k == 0, "lakh").when(k == 1, "Crore").when(k == 2, "million").otherwise("rupees"))
    number = F.regexp_extract(said, r"([0-9]+(?:\.[0-9]+)?)", 1).cast("double")
    unit = F.lower(F.regexp_extract(said, r"([A-Za-z]+)\s*$", 1))
    scale = F.when(unit == "lakh", 1e5).when(unit == "crore", 1e7).when(unit == "million", 1e6).otherwise(1.0)
    return table(spark, d, "events").select("event_id", (number * scale).alias("amount"))


@query("date_parse_formats", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2")
def dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("soon")
    parsed = F.coalesce(F.try_to_date(s, "dd-MM-yyyy"), F.try_to_date(s, "yyyy/MM/dd"))
    return table(spark, d, "orders").select("o_orderkey", parsed.alias("d"))


@query("block_deals", """SELECT d, symbol, client, side, qty, price, qty * price AS value FROM (SELECT l_shipdate::DATE AS d, l_partkey AS symbol, l_suppkey AS client, l_returnflag AS side, l_quantity AS qty, l_extendedprice AS price, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0)
QUALIFY row_number() OVER (PARTITION BY d, symbol, client, side, qty, price ORDER BY l_orderkey DESC, l_linenumber DESC) = 1""")
def block_deals(spark: SparkSession, d: str) -> DataFrame:
    """Deals equal in all six fields count once; which row stays doesn't matter, so no sort is needed."""
    deals = table(spark, d, "lineitem").where("l_quantity > 0").select(
        F.to_date("l_shipdate").alias("d"), F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("client"), F.col("l_returnflag").alias("side"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price")
    )
    return deals.distinct().withColumn("value", F.col("qty") * F.col("price"))


@query("deal_stats", "SELECT round(sum(l_quantity * l_extendedprice), 2) AS total, count(DISTINCT l_partkey) AS stocks, max(l_shipdate)::DATE AS latest FROM lineitem")
def deal_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("total"), F.countDistinct("l_partkey").alias("stocks"), F.to_date(F.max("l_shipdate")).alias("latest"))


@query("company_relevance", r"SELECT doc_id, regexp_matches(text, '(^|[^A-Z0-9])THE([^A-Z0-9]|$)') AS ticker_hit, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), ['apache', 'license', 'version'])) >= 2 AS name_hit FROM documents")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.array_intersect(F.split(F.lower("text"), "[^a-z]+"), F.array(*map(F.lit, ("apache", "license", "version"))))
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike("(?<![A-Z0-9])THE(?![A-Z0-9])").alias("ticker_hit"), (F.size(tokens) >= 2).alias("name_hit"))


@query("query_cache_key", r"SELECT doc_id, left(sha256(trim(regexp_replace(lower(text), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), 32) AS cache_key FROM documents")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    norm = F.trim(F.regexp_replace(F.lower("text"), tx.SPACE, " "))
    return table(spark, d, "documents").select("doc_id", F.left(F.sha2(norm.cast("binary"), 256), F.lit(32)).alias("cache_key"))


@query("evidence_chunks_top2", "SELECT source, doc_id FROM (SELECT source, doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS score FROM documents) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 2")
def chunks_top2(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "documents").select("source", "doc_id", tx.count_of(F.col("text"), "the").alias("score")).where("score > 0")
    return top_per_group(scored, ["source"], [F.desc("score"), F.asc("doc_id")], 2).select("source", "doc_id")
