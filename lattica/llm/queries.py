"""The corpus operators as queries over the whole driver tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, fingerprint, language_id, line_dedup, near_dup, packing, secret_scan, sharding, url_filter, warc
from lattica.llm._common import stage


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    told = Path(path or tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), told)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balance(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.findings_by_path(docs, secret_scan.scan(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["order"] < len(secret_scan.BASE))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(r.kind).alias(f"n_{r.kind}") for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(hits)


def held_out(id_col: str = "doc_id"):
    """Null for a null id: such rows are neither learned from nor held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def op7_language_id(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = language_id.vocabulary(path or tokenizer_path("piece_bpe_32k.model"))
    model = language_id.train(docs, pieces, ~held_out())
    told = language_id.identify(docs, model)
    return told.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stage(warc.write_archives(warc.with_revisits(_table(spark, sf_dir, "pages"))), "archives")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_best_fit_packing, op3_sharding, op4_secret_scan, op5_near_dedup, op6_decontaminate, op7_language_id,
        op8_warc, op9_fingerprint, op10_line_dedup,
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
m AS (SELECT s, n, max(page_id) AS f FROM d WHERE n >= 1000 GROUP BY s, n)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
  CASE WHEN m.f <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.f <> d.page_id THEN m.f END AS refers_to
FROM d LEFT JOIN m ON d.s = m.s AND d.n = m.n
"""

ORACLE["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, k AS i, x AS line,
    translate(trim(x, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
r AS (SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(l.doc_id <> r.holder, false) AS gone FROM l LEFT JOIN r USING (key))
GROUP BY doc_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _secret_rule_sql(order: int, rule: secret_scan.Rule) -> str:
    """(doc_id, start, o, n, kind) of a rule's spans: the texts between matches and the matches, laid end to end."""
    pattern = rule.pattern.replace("'", "''")
    return rf"""
SELECT doc_id, b + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, {order} AS o, length(m[i]) AS n, '{rule.kind}' AS kind
FROM (SELECT doc_id, m, g, i, list_sum(list_transform(s[1:i], lambda x: length(x))) AS b
      FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS m,
              regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM texts), unnest(range(1, len(m) + 1)) AS u(i))
WHERE length(g[i]) >= {rule.least}"""


_RULES = (*secret_scan.BASE, *secret_scan.MORE)
_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
_FOUND = " UNION ALL ".join(_secret_rule_sql(i, r) for i, r in enumerate(_RULES))

ORACLE["op4_secret_scan"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, o, kind, start, concat_ws(':', kind, start, start + n) AS told FROM ({_FOUND})),
g AS (SELECT doc_id, {_COUNTS},
        string_agg(told, ',' ORDER BY start, o) FILTER (WHERE o < {len(secret_scan.BASE)}) AS base, string_agg(told, ',' ORDER BY start, o) AS spans
      FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN g USING (doc_id)
"""

#: Every pair of different shingle sets that share a shingle is counted, and links are followed to the least doc_id.
ORACLE["op5_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
c AS MATERIALIZED (SELECT sh, len(sh) AS n, min(doc_id) AS class FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS MATERIALIZED (SELECT class, n, unnest(sh) AS g FROM c),
p AS MATERIALIZED (
  SELECT a.class AS u, b.class AS v FROM x a JOIN x b ON a.g = b.g AND a.class <> b.class AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT class AS id, class AS reached FROM c UNION SELECT r.id, p.v FROM r JOIN p ON r.reached = p.u),
k AS (SELECT id, min(reached) AS component FROM r GROUP BY id)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN k ON k.id = c.class
"""

ORACLE["op6_decontaminate"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[k:k + 12], ' ') AS g
      FROM b, unnest(range(1, greatest(len(ws) - 11, 2))) AS u(k) WHERE len(ws) > 0),
h AS MATERIALIZED (SELECT w.doc_id, k, i.n, i.item_id
      FROM (SELECT doc_id, k, l.n, array_to_string(ws[k:k + l.n - 1], ' ') AS g
            FROM w, (SELECT DISTINCT n FROM i) l, unnest(range(1, len(ws) - l.n + 2)) AS u(k)) w
      JOIN i ON w.n = i.n AND w.g = i.g),
n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
