"""The registered queries of this subpackage: op1 to op13, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fill_middle, filter_audit, language, neighbours, pii, quality, simhash, token_counts, toxicity, warc
from .tables import in_fold, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.in_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    found = language.identify(docs.select("doc_id", "text"), language.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, count(*) AS n, list([role, text] ORDER BY turn NULLS FIRST, role, text) AS l,
             string_agg('<|im_start|>' || replace(role, '<|', '<\\|') || chr(10) || replace(text, '<|', '<\\|') || '<|im_end|>' || chr(10),
                        '' ORDER BY turn NULLS FIRST, role, text) AS rendered
           FROM d GROUP BY conv_id)
SELECT conv_id, n AS n_turns, rendered FROM c
WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.n > c.n AND o.l[1:c.n] = c.l)
  AND NOT EXISTS (SELECT 1 FROM c o WHERE o.n = c.n AND o.l = c.l AND o.conv_id < c.conv_id)
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base_pii"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    base = F.sha2(pii.spans_text(F.col("base_pii")).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
     k AS (SELECT d, max(page_id) AS m FROM p GROUP BY d)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (((instr('0123456789abcdef', substr(d, (5 * i) // 4 + 1, 1)) - 1) * 16
      + instr('0123456789abcdef', substr(d, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p JOIN k USING (d)
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        token_counts.utf8_bytes(F.col("text")).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
     l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     f AS (SELECT d.part, map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
             'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
             'E': coalesce(d.doc_id > first, false)} AS fails, coalesce(q, 0) = 1 AS good, coalesce(x, 0) = 1 AS toxic
           FROM d JOIN least USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
     g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
     c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
     o AS (SELECT c1.c || c2.c || c3.c || c4.c || c5.c AS filter_order FROM c c1, c c2, c c3, c c4, c c5
           WHERE len(list_distinct([c1.c, c2.c, c3.c, c4.c, c5.c])) = 5),
     s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS earlier,
             string_split(filter_order, '') AS letters FROM o, range(1, 6) r(step)),
     m AS (SELECT s.*, g.*, coalesce(fails[own], false) AS failed,
             step > 1 AND len(list_filter(earlier, lambda e: coalesce(fails[e], false))) > 0 AS gone,
             len(list_filter(letters, lambda e: coalesce(fails[e], false))) AS failures FROM s, g),
     r AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT failed AND NOT gone) AS kept, sum(n) FILTER (failed AND NOT gone) AS removed,
             sum(n) FILTER (failed AND gone) AS redundant, sum(n) FILTER (failed AND failures = 1) AS unique_fails,
             sum(good) FILTER (failed AND NOT gone) AS good_lost, sum(toxic) FILTER (failed AND NOT gone) AS toxic_lost
           FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM r
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = F.col("fim")
    return made.select(
        "doc_id",
        fim.n.alias("n"),
        fim.form.alias("form"),
        fim.prefix_chars.alias("prefix_chars"),
        fim.middle_chars.alias("middle_chars"),
        F.sha2(fim.output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(fim.output, fim.form).cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
     h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS c1, ('0x' || x[9:16])::BIGINT % (n + 1) AS c2,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || x[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
     p AS (SELECT *, t[1:least(c1, c2)] AS p, t[least(c1, c2) + 1:greatest(c1, c2)] AS m, t[greatest(c1, c2) + 1:] AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN greatest(c1, c2) - least(c1, c2) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_chat": op4_chat,
    "op5_pii": op5_pii,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_neighbours": op10_neighbours,
    "op11_quality": op11_quality,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {"op4_chat": OP4_SQL, "op8_warc": OP8_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
