"""Reconstruction-shaped tables made of the driver's tables, in SQL that Spark and DuckDB both read.

No reconstruction data ships, so orders stand in for tracks, suppliers for images, parts for features, quantity and
discount for grid places, prices for heights, and events for task events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "samples": "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS r, CAST(round(l_discount * 100) AS BIGINT) AS c, l_extendedprice / 1013 AS z, l_tax * 1.0013 AS conf, l_discount AS err, CAST(l_linenumber AS BIGINT) AS tile, CAST(l_orderkey AS BIGINT) AS id, l_returnflag AS flag FROM {lineitem}",
    "points": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 37 AS y, CAST(p_partkey % 29 AS DOUBLE) AS z, CAST(p_partkey % 13 AS DOUBLE) AS rank FROM {part}",
    "queries": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 37 AS y, CAST(p_partkey % 29 AS DOUBLE) AS z FROM {part} WHERE p_partkey % 100 = 0",
    "images": "SELECT CAST(s_suppkey AS BIGINT) AS idx, s_acctbal AS x, CAST(s_nationkey * 4 + 20 AS DOUBLE) AS radius, s_name AS name FROM {supplier}",
    "obs": "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS track, CAST(l_suppkey AS BIGINT) AS image, CAST(l_partkey AS BIGINT) AS feature FROM {lineitem}",
    "residuals": "SELECT CASE l_returnflag WHEN 'A' THEN 'control' WHEN 'R' THEN 'check' ELSE 'tie' END AS role, (l_quantity - 25) / 10 AS residual FROM {lineitem}",
    "sparse": "SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS line, l_discount * 40 AS reproj, l_quantity AS angle, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 100 END AS uncertainty, CAST(l_linenumber AS BIGINT) AS length FROM {lineitem}",
    "chain": "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS a, CAST(o_custkey + 1 AS BIGINT) AS b, CAST(o_custkey % 17 AS BIGINT) AS n FROM {orders}",
    "task_events": "SELECT CAST(user_id AS BIGINT) AS run, ts AS moment, CAST(event_id AS BIGINT) AS seq, event_type AS state FROM {events}",
    "frames": "SELECT CAST(o_orderkey AS BIGINT) AS frame, o_totalprice / 500000 AS quality, o_orderstatus AS kind FROM {orders}",
    "variants": "SELECT CAST(l_suppkey AS BIGINT) AS a, CAST(l_partkey AS BIGINT) AS b, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS variant, l_linestatus = 'F' AS compatible, l_returnflag <> 'R' AS passed, CAST(l_quantity AS BIGINT) AS inliers, CAST(l_quantity + l_linenumber AS BIGINT) AS total, CAST(l_linenumber AS BIGINT) AS created FROM {lineitem}",
    "pair_matches": "SELECT CAST(l_suppkey AS BIGINT) AS a, CAST(l_suppkey + 1 AS BIGINT) AS b, l_returnflag = 'R' AS inlier, l_quantity / 50 AS xa, l_discount * 10 AS ya, l_tax * 12 AS xb, l_discount * 9 AS yb FROM {lineitem}",
    "field": "SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, CAST(l_linenumber AS BIGINT) AS k, avg(l_quantity) - 25.5e0 AS value FROM {lineitem} GROUP BY 1, 2, 3",
    "body_vertices": "SELECT s * 10 + b AS vid, r * cos(radians(90e0 - 22.5e0 * b)) * cos(radians(360e0 * s / n)) AS x, r * cos(radians(90e0 - 22.5e0 * b)) * sin(radians(360e0 * s / n)) AS y, r * sin(radians(90e0 - 22.5e0 * b)) AS z FROM (SELECT CAST(l_suppkey AS BIGINT) AS s, CAST(l_linenumber AS BIGINT) AS b, 100e0 + avg(l_quantity) AS r FROM {lineitem} GROUP BY 1, 2) CROSS JOIN (SELECT count(DISTINCT l_suppkey) AS n FROM {lineitem}) UNION ALL SELECT CAST(p AS BIGINT), 0e0, 0e0, CAST(125 * (2 * p + 3) AS DOUBLE) FROM (VALUES (-1), (-2)) AS q(p)",
    "body_faces": "SELECT (s * 10 + b) * 2 + k AS fid, CASE WHEN b = 0 THEN -1 WHEN b = 7 THEN -2 ELSE s * 10 + b END AS v0, CASE WHEN b = 0 THEN s * 10 + 1 WHEN b = 7 THEN t * 10 + 7 ELSE t * 10 + b + k END AS v1, CASE WHEN b = 0 THEN t * 10 + 1 WHEN b = 7 THEN s * 10 + 7 WHEN k = 0 THEN t * 10 + b + 1 ELSE s * 10 + b + 1 END AS v2 FROM (SELECT s, (s + 1) % n AS t FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS s FROM {lineitem}) CROSS JOIN (SELECT count(DISTINCT l_suppkey) AS n FROM {lineitem})) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS u(b) CROSS JOIN (VALUES (0), (1)) AS w(k) WHERE b BETWEEN 1 AND 6 OR k = 0",
    "vectors": "SELECT CAST(vec_id AS BIGINT) AS id, embedding AS v, CAST(label AS BIGINT) AS label FROM {embeddings}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table."""
    used = set(re.findall(r"\{(\w+)\}", TABLES[name]))
    return spark.sql(TABLES[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql(text: str) -> str:
    """SQL for DuckDB with the stand-ins it names as common table expressions."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", text)]
    body = ", ".join(f"{n} AS (" + re.sub(r"[{](\w+)[}]", r"\1", TABLES[n]) + ")" for n in used)
    if not used:
        return text
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", text)
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE\b", text) else ""
    return f"WITH {recursive}{body}, {rest}" if rest != text else f"WITH {body} {text}"
