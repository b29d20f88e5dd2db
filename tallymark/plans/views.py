"""Views over the driver's tables that stand for labels, applications, reviews and cases.

The text of a view is the same for Spark and for DuckDB, but for the function that makes rows of a
series. They are test data definitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels")

VIEWS = {
    "v_app": """
SELECT p.p_partkey AS app_id,
  concat('LABEL_', CAST(p.p_partkey AS STRING), CASE WHEN p.p_partkey % 3 = 0 THEN '.JPG' ELSE '.png' END) AS filename,
  p.p_name AS brand, p.p_type AS class_type, CAST(p.p_size AS DOUBLE) AS abv,
  CASE p.p_partkey % 5 WHEN 0 THEN '750 mL' WHEN 1 THEN '0.75 L' WHEN 2 THEN '12 fl oz' WHEN 3 THEN '680 mL' ELSE '4 L' END AS net_contents,
  s.s_name AS bottler_name,
  concat(n.n_name, ', Kentucky 40004') AS bottler_address,
  CASE WHEN n.n_regionkey = 0 THEN 'United States' ELSE n.n_name END AS country,
  p.p_partkey % 11 <> 0 AS warning_required,
  CASE p.p_partkey % 4 WHEN 0 THEN 'distilled-spirits' WHEN 1 THEN 'wine' WHEN 2 THEN 'malt-beverage' ELSE 'unknown' END AS beverage
FROM part p
JOIN (SELECT count(*) AS n_supp FROM supplier) c ON TRUE
JOIN supplier s ON s.s_suppkey = p.p_partkey % c.n_supp
JOIN nation n ON n.n_nationkey = s.s_nationkey
""",
    "v_ext": """
SELECT a.app_id AS label_id, concat('label_', CAST(a.app_id AS STRING), '.jpeg') AS filename,
  CASE a.app_id % 6 WHEN 0 THEN a.brand WHEN 1 THEN upper(a.brand) WHEN 2 THEN concat(a.brand, ' llc')
    WHEN 3 THEN NULL WHEN 4 THEN concat('"', a.brand, '"') ELSE 'zzzz' END AS brand_value,
  CASE a.app_id % 5 WHEN 0 THEN concat(CAST(CAST(a.abv AS INT) AS STRING), '% Alc./Vol.')
    WHEN 1 THEN concat(CAST(CAST(2 * a.abv AS INT) AS STRING), ' Proof')
    WHEN 2 THEN concat('Alc. ', CAST(CAST(a.abv + 1 AS INT) AS STRING), ' percent by vol.')
    WHEN 3 THEN NULL ELSE 'n/a' END AS abv_text,
  CASE a.app_id % 7 WHEN 0 THEN '700 mL' WHEN 1 THEN '25.4 FL OZ' WHEN 2 THEN NULL ELSE a.net_contents END AS net_text,
  CASE a.app_id % 4 WHEN 0 THEN concat('bottled by ', a.bottler_name) WHEN 1 THEN a.bottler_name WHEN 2 THEN NULL ELSE concat('DISTILLED BY  ', a.bottler_name) END AS bottler_evidence,
  CASE a.app_id % 5 WHEN 0 THEN 'Product of U.S.A.' WHEN 1 THEN concat('Made in ', a.country) WHEN 2 THEN NULL ELSE a.country END AS origin_value,
  CASE a.app_id % 4 WHEN 0 THEN 'blurry text with glare' WHEN 1 THEN 'right-hand corner ok' WHEN 2 THEN 'finger covering edge' ELSE '' END AS quality_note,
  CAST((a.app_id % 10) * 10 + 5 AS DOUBLE) / 100 AS confidence,
  a.app_id % 13 = 0 AS image_poor
FROM v_app a WHERE a.app_id % 17 <> 0
UNION ALL
SELECT a.app_id + 1000000, concat('Label_', CAST(a.app_id AS STRING), '.gif'), a.brand, NULL, a.net_contents, NULL, NULL, '', CAST(0.5 AS DOUBLE), FALSE
FROM v_app a WHERE a.app_id % 50 = 0
""",
    "v_statement": """
SELECT p_partkey AS label_id,
  CASE p_partkey % 8
    WHEN 0 THEN k.prefix || ' ' || k.body
    WHEN 1 THEN k.prefix || ' ' || upper(k.body)
    WHEN 2 THEN 'Government Warning: ' || k.body
    WHEN 3 THEN k.body
    WHEN 4 THEN k.prefix || ' ' || replace(k.body, 'General,', 'General')
    WHEN 5 THEN k.prefix || ' ' || k.body || ' Enjoy.'
    WHEN 6 THEN '  ' || k.prefix || '   ' || k.body || '  '
    ELSE '' END AS statement
FROM part JOIN (SELECT 'GOVERNMENT WARNING:' AS prefix,
  '(1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.' AS body) k ON TRUE
""",
    "v_event": """
SELECT event_id, ts, user_id AS item_id,
  CASE event_type WHEN 'click' THEN 'start' WHEN 'signup' THEN 'retry' WHEN 'error' THEN 'error' ELSE 'complete' END AS kind,
  value AS duration_ms
FROM events
""",
    "v_review": """
SELECT o.o_orderkey AS review_id, o.o_orderdate AS created_at, c.c_name AS reviewer, o.o_orderpriority AS brand,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass-with-warnings' WHEN 2 THEN 'fail' WHEN 3 THEN 'needs-manual-review' ELSE 'request-better-image' END AS overall,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' WHEN 2 THEN 'beer' ELSE 'unknown' END AS beverage,
  o.o_orderkey % 9 = 0 AS has_overrides, o.o_orderkey % 20 AS batch_id,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderkey % 150 END AS scenario_id,
  o.o_totalprice AS processing_ms, o.o_orderkey % 6 = 0 AS quality_issue, o.o_orderkey % 12 <> 5 AS ok
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
""",
    "v_field": """
SELECT l_orderkey AS review_id, l_linenumber AS field_no,
  CASE CAST(l_quantity AS INT) % 8 WHEN 0 THEN 'fail' WHEN 1 THEN 'likely-match' WHEN 2 THEN 'warning' WHEN 3 THEN 'missing' WHEN 4 THEN 'low-confidence' WHEN 5 THEN 'manual-review' WHEN 6 THEN 'not-required' ELSE 'pass' END AS ai_status,
  CASE WHEN l_partkey % 5 = 0 THEN 'pass' WHEN l_partkey % 7 = 0 THEN 'fail' END AS human_status,
  CASE WHEN l_partkey % 5 = 0 OR l_partkey % 7 = 0 THEN CASE l_suppkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'checked by eye' ELSE 'zoomed' END END AS reason
FROM lineitem
""",
    "v_usage": """
SELECT l_orderkey AS label_id, CASE WHEN l_returnflag = 'R' THEN 'fallback' ELSE 'primary' END AS model_role,
  CAST(l_quantity AS INT) * 100 AS prompt_tokens, CAST(l_quantity AS INT) * 7 AS completion_tokens, l_shipdate AS used_at
FROM lineitem
""",
    "v_golden": """
SELECT l.doc_id AS case_id, d.source AS tag, l.toxic = 1 AS must_fail, d.n_chars % 17 = 0 AS skipped,
  CASE WHEN l.quality = 1 THEN 'pass' ELSE 'fail' END AS expected,
  CASE WHEN d.n_chars % 10 < 8 THEN CASE WHEN l.quality = 1 THEN 'pass' ELSE 'fail' END ELSE 'needs-manual-review' END AS actual,
  CAST(d.n_chars AS DOUBLE) AS latency_ms, CAST(d.n_chars AS DOUBLE) / 100000 AS cost_usd
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""",
    "v_pixel": """
SELECT image_id, k % 25 AS x, CAST(floor(k / 25) AS INT) AS y,
  (image_id * 31 + (k % 25) * 17 + CAST(floor(k / 25) AS INT) * 13 * (image_id % 3)) % 256 AS lum
FROM (SELECT p_partkey AS image_id, explode(sequence(0, 624)) AS k FROM part)
""",
}

#: Joins with a hint are not reordered. Without it a filter on columns of part and supplier would join all of the two with each
#: other, before the count that pairs them up is there.
_COUNTED = ("\nSELECT p.p_partkey AS app_id", "\nSELECT /*+ BROADCAST(c) */ p.p_partkey AS app_id")
#: Views whose made-up texts are many times as large as the columns they come from, by which the planner would broadcast them.
_WIDE = ("v_statement",)
#: Small tables of which each row gives a label, an image or a statement that takes long.
_SEEDS = ("part",)

_NAMES = re.compile(rf"\b(FROM|JOIN) ({'|'.join((*TABLES, *VIEWS))})\b")


def dealt(rows: DataFrame) -> DataFrame:
    """A table dealt over all cores, where its file has few splits: one row group is one task, however many splits its bytes make."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 4 * cores else rows


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view."""
    if name not in VIEWS:
        read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return dealt(read) if name in _SEEDS else read
    made = over(spark, sf_dir, VIEWS[name].replace(*_COUNTED))
    return made.hint("merge") if name in _WIDE else made


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables and views that it names."""
    used = {m[2] for m in _NAMES.finditer(sql)}
    return spark.sql(_NAMES.sub(r"\1 {\2}", sql), **{n: frame(spark, sf_dir, n) for n in used})


def with_views(sql: str, *, parts: str = "") -> str:
    """The SQL for DuckDB: with the views that it or they name, and further ``parts`` (name AS (...), ...)."""
    needed: list[str] = []

    def need(text: str) -> None:
        for m in _NAMES.finditer(text):
            if m[2] in VIEWS and m[2] not in needed:
                need(VIEWS[m[2]])
                needed.append(m[2])

    need(parts)
    need(sql)
    made = [f"{n} AS ({VIEWS[n].replace('explode(sequence(0, 624))', 'unnest(generate_series(0, 624))')})" for n in needed] + ([parts] if parts else [])
    return f"WITH {', '.join(made)} {sql}" if made else sql
