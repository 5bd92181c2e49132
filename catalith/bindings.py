"""The catalogue's tables as views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from catalith.catalog import Catalog

_DATE = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS INT)"
_MONTH = "CAST(year({0}) * 100 + month({0}) AS INT)"
_VEHICLE = """CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE l_suppkey END AS series_id, l_partkey % 50 AS model_id, CAST(l_linenumber AS BIGINT) AS engine_id,
  14001 + l_partkey % 12 AS body_id, CASE WHEN l_quantity < 10 THEN 0 ELSE CAST(22000 + l_linenumber AS BIGINT) END AS gearbox_id"""
_KIND = "CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 3000 WHEN 2 THEN 4000 ELSE 5000 END"

BOUND = {
    "applicability": f"SELECT l_orderkey AS doc_id, {_VEHICLE}, {_MONTH.format('l_shipdate')} AS produced_from, {_MONTH.format('l_shipdate')} + 200 AS produced_to, 1 AS lead_type FROM {{lineitem}}",
    "document": f"SELECT o_orderkey AS id, concat('D', CAST(o_orderkey % 500 AS STRING)) AS code, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS doc_type_id, o_orderpriority AS title, {_DATE.format('o_orderdate')} AS published, CAST(o_orderkey % 100 AS INT) AS sort, 0 AS security, 1 AS enabled FROM {{orders}}",
    "node_document": "SELECT o_custkey % 25 AS node_id, o_orderkey AS doc_id, 0 AS security, CAST(200 AS BIGINT) AS doc_type_id FROM {orders}",
    "symptom_document": "SELECT o_custkey % 25 AS node_id, o_orderkey AS doc_id, 0 AS security FROM {orders}",
    "label": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM {nation}",
    "doc_type": "SELECT CAST(CASE r_regionkey WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 300 WHEN 3 THEN 1600 ELSE 2100 END AS BIGINT) AS id, r_name AS code, concat('type ', r_name) AS name, CAST(9 - r_regionkey AS INT) AS sort, CAST(CASE r_regionkey WHEN 3 THEN 5 ELSE 2 END AS INT) AS method, CAST(1 AS BIGINT) AS access, 1 AS enabled FROM {region}",
    "vehicle_model": f"SELECT l_suppkey AS series_id, concat('S', CAST(l_suppkey AS STRING)) AS series_name, l_partkey % 50 AS model_id, concat('M', CAST(l_partkey % 50 AS STRING)) AS model_name, 14001 + l_partkey % 12 AS body_id, {_MONTH.format('l_shipdate')} AS produced_from, {_MONTH.format('l_shipdate')} + 100 AS produced_to FROM {{lineitem}}",
    "vehicle_type": "SELECT p_partkey AS type_id, p_partkey % 100 AS series_id, p_partkey % 50 AS model_id, CAST(p_size AS BIGINT) AS engine_id, p_partkey % 12 AS body_id, p_partkey % 7 AS gearbox_id, p_partkey % 3 AS drive_id, '' AS equipment FROM {part}",
    "chassis_range": "SELECT p_partkey % 10 AS area, p_partkey * 100 AS serial_from, p_partkey * 100 + 999 AS serial_to, p_partkey AS type_id, 199001 + CAST(p_size AS INT) AS produced FROM {part}",
    "nav_node": f"SELECT p_partkey AS node_id, p_brand AS code, p_name AS name, CAST(p_size AS INT) AS sort, CAST({_KIND} AS INT) AS variant_kind, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 40 END AS variant_value, CASE WHEN p_partkey % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE p_partkey % 3 END AS parent_id, 1 AS enabled, CAST(200 AS BIGINT) AS doc_type_id FROM {{part}}",
    "nav_applicability": "SELECT l_partkey AS node_id, l_suppkey AS series_id, l_partkey % 50 AS model_id, CAST(l_linenumber AS BIGINT) AS engine_id, CAST(200 AS BIGINT) AS doc_type_id FROM {lineitem}",
    "path_node": """SELECT CAST(1 AS BIGINT) AS path_id, node_id, parent_id, concat('N', CAST(node_id AS STRING)) AS code, name, CAST(abs(node_id) % 7 AS INT) AS sort, 1 AS enabled, 0 AS variant_kind, CAST(0 AS BIGINT) AS variant_value FROM (
  SELECT CAST(-1 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS parent_id, 'component' AS name UNION ALL SELECT CAST(-2 AS BIGINT), CAST(0 AS BIGINT), 'diagnosis'
  UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT), CAST(-1 AS BIGINT), r_name FROM {region}
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), n_name FROM {nation}
  UNION ALL SELECT c_custkey + 1000, CAST(c_nationkey + 100 AS BIGINT), c_name FROM {customer}) x""",
    "symptom_applicability": """SELECT CAST(1 AS BIGINT) AS path_id, node_id, series_id, CAST(1 AS BIGINT) AS model_id, CAST(1 AS BIGINT) AS engine_id FROM (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS node_id, CAST(7 AS BIGINT) AS series_id FROM {region}
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 8 END AS BIGINT) FROM {nation}
  UNION ALL SELECT c_custkey + 1000, CAST(CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 8 END AS BIGINT) FROM {customer}) x""",
    "news": f"SELECT event_id AS id, user_id AS doc_id, CAST(1 AS BIGINT) AS doc_type_id, {_DATE.format('ts')} AS published, event_type AS title, CAST(event_id % 10 AS INT) AS sort, 1 AS enabled FROM {{events}}",
    "vehicle_action": "SELECT p_partkey AS doc_id, CAST(p_size AS INT) AS sort, 20200101 AS published, p_name AS title, 1 AS enabled FROM {part}",
    "chassis_document": "SELECT p_partkey AS doc_id, p_partkey % 10 AS area, p_partkey * 100 AS serial_from, p_partkey * 100 + 99999 AS serial_to FROM {part}",
    "document_file": "SELECT l_orderkey AS doc_id, concat('F', CAST(l_linenumber AS STRING)) AS file_name, l_returnflag AS device_type, CAST(l_suppkey AS STRING) AS device_code FROM {lineitem}",
    "doc_type_applicability": "SELECT CAST(CASE WHEN l_suppkey % 10 = 0 THEN 100 ELSE 200 END AS BIGINT) AS doc_type_id, CASE WHEN l_suppkey % 10 = 0 AND l_linenumber = 7 THEN 0 ELSE l_suppkey END AS series_id, l_partkey % 50 AS model_id FROM {lineitem}",
    "lead_type": "SELECT p_partkey AS type_id, CAST(p_size % 5 AS INT) AS lead_type FROM {part}",
    "path": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS INT) AS sort, CAST(n_nationkey % 2 AS INT) AS enabled FROM {nation}",
    "group_applicability": "SELECT CAST(1 AS BIGINT) AS path_id, CAST(n_nationkey + 100 AS BIGINT) AS node_id, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE 8 END AS BIGINT) AS series_id FROM {nation}",
    "image_blob": "SELECT concat('PAGE/', CAST(page_id AS STRING), '.PNG') AS id, '' AS path, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'image/webp' END AS content_type, {bytes} AS data FROM {pages}",
    "doc_blob": "SELECT concat('PAGE/', CAST(page_id AS STRING), '.RTF') AS id, '' AS path, 'application/rtf' AS content_type, {bytes} AS data FROM {pages}",
}
# parts as documents, with the order lines' hotspots and references
PARTS = {
    "document": "SELECT p_partkey AS id, p_brand AS code, CAST(p_size AS BIGINT) AS doc_type_id, p_name AS title, 20200101 AS published, CAST(p_size AS INT) AS sort, 0 AS security, 1 AS enabled FROM {part}",
    "applicability": f"SELECT l_partkey AS doc_id, {_VEHICLE} FROM {{lineitem}}",
    "doc_type": "SELECT s_suppkey AS id, s_name AS code, concat('type ', s_name) AS name, CAST(s_suppkey AS INT) AS sort, 2 AS method, CAST(0 AS BIGINT) AS access, 1 AS enabled FROM {supplier}",
    "hotspot": "SELECT CASE WHEN l_orderkey < 50 THEN CAST(1 AS BIGINT) ELSE l_orderkey END AS source_id, l_linenumber AS number, l_partkey AS target_id, 1 AS enabled FROM {lineitem}",
    "document_ref": "SELECT l_orderkey % 100 AS source_id, l_partkey AS target_id, 1 AS enabled FROM {lineitem}",
}


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)) - {"bytes"})


def catalog(spark: SparkSession, sf_dir: str, bound: dict[str, str] = BOUND) -> Catalog:
    """A catalogue whose tables are bound lazily, each on its first use."""
    return _Bound(spark, sf_dir, bound)


class _Bound(Catalog):
    def __init__(self, spark: SparkSession, sf_dir: str, bound: dict[str, str]) -> None:
        super().__init__(spark)
        self.sf_dir, self.bound = sf_dir, bound

    def has(self, name: str) -> bool:
        if name not in self.tables and name in self.bound:
            sql = self.bound[name]
            frames = {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in _names(sql)}
            self.tables[name] = self.spark.sql(sql.replace("{bytes}", "CAST(html AS BINARY)"), **frames)
        return name in self.tables


def ctes(*names: str, bound: dict[str, str] = BOUND) -> str:
    """The bound tables as common table expressions for DuckDB."""
    parts = []
    for n in names:
        sql = bound[n].replace("{bytes}", "html")
        for t in _names(sql):
            sql = sql.replace("{" + t + "}", t)
        parts.append(f"b_{n} AS ({sql})")
    return "WITH RECURSIVE " + ",\n".join(parts)
