"""The lake's tables as views over the generic star schema, so that every operator has data to run on; and the same
views in DuckDB's SQL for the oracles. An order stands for a filing, a customer for an issuer, a line item for a
reported fact or an audit engagement, a supplier for an audit partner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-06-30"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: SQL that both engines read alike
FILING = """SELECT lpad(CAST(o_custkey AS {s}), 10, '0') AS issuer_cik, concat('00-', lpad(CAST(o_orderkey AS {s}), 8, '0')) AS accession,
  CASE WHEN o_orderkey % 9 = 0 THEN 'NT 10-K' WHEN o_orderkey % 9 = 1 THEN ' 10-k ' WHEN o_orderkey % 9 IN (2, 3) THEN '10-K' WHEN o_orderkey % 9 = 4 THEN '10-K/A'
    WHEN o_orderkey % 9 = 5 THEN '8-K' WHEN o_orderkey % 9 = 6 THEN 'UPLOAD' WHEN o_orderkey % 9 = 7 THEN 'CORRESP' ELSE '20-F' END AS form,
  o_orderdate AS filing_date, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE date_trunc('year', o_orderdate) END AS report_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS acceptance_datetime,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Item 4.02, 9.01' WHEN o_orderkey % 5 = 1 THEN '3.01;5.02;3.01' WHEN o_orderkey % 5 = 2 THEN ' nan ' WHEN o_orderkey % 5 = 3 THEN NULL ELSE '4.01 Revision' END AS items,
  concat('d', CAST(o_orderkey AS {s}), '.htm') AS primary_document,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Part III and exhibit' WHEN o_orderkey % 6 = 1 THEN 'A revision of 10-K' WHEN o_orderkey % 6 = 2 THEN NULL ELSE 'annual report' END AS primary_doc_description
FROM orders"""
PERIOD = """SELECT concat('00-', lpad(CAST(o_orderkey AS {s}), 8, '0')) AS accession, date_trunc('month', o_orderdate) AS fsds_fiscal_period_end FROM orders WHERE o_orderkey % 2 = 1"""
ISSUER = """SELECT lpad(CAST(c_custkey AS {s}), 10, '0') AS issuer_cik, c_name AS entity_name, CAST(c_nationkey AS {s}) AS sic, c_mktsegment AS entity_type FROM customer"""
FACT = """SELECT concat('00-', lpad(CAST(l_orderkey AS {s}), 8, '0')) AS adsh,
  CASE l_linenumber WHEN 1 THEN 'Assets' WHEN 2 THEN 'Liabilities' WHEN 3 THEN 'Revenues' WHEN 4 THEN 'NetIncomeLoss' WHEN 5 THEN 'AssetsCurrent' WHEN 6 THEN 'LiabilitiesCurrent' WHEN 7 THEN 'LongTermDebt' ELSE 'Other' END AS tag,
  CASE WHEN l_suppkey % 4 = 0 THEN 'us-gaap/2020' ELSE 'us-gaap/2021' END AS taxonomy_version, date_trunc('year', l_shipdate) AS fact_date, CAST(l_suppkey % 3 AS INT) AS quarters,
  CASE WHEN l_suppkey % 11 = 0 THEN 'shares' WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'USD' END AS unit, CASE WHEN l_suppkey % 17 = 0 THEN 'seg' END AS segments, CAST(NULL AS {s}) AS coreg,
  CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(28,4)) AS {s}) AS value_text, CAST(round(l_extendedprice, 2) AS DECIMAL(28,4)) AS value FROM lineitem"""
FORM_AP = """SELECT lpad(CAST(o_custkey AS {s}), 10, '0') AS issuer_cik, date_trunc('year', o_orderdate) AS fiscal_period_end, l_shipdate AS filing_date, concat(CAST(l_orderkey AS {s}), '-', CAST(l_linenumber AS {s})) AS form_filing_id,
  CASE WHEN l_suppkey % 19 = 0 THEN ' ' ELSE concat('P', CAST(l_suppkey % 40 AS {s})) END AS engagement_partner_id, l_quantity AS number_of_participants FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
DOCUMENT = """SELECT concat('00-', lpad(CAST(doc_id AS {s}), 8, '0')) AS accession, CASE WHEN doc_id % 3 = 0 THEN concat('<p>EXPLANATORY NOTE</p> the restated ', substr(text, 1, 60), ' PART II rest') WHEN doc_id % 3 = 1 THEN concat('Introductory Note ', substr(text, 1, 40)) ELSE 'nothing' END AS document_text FROM documents"""

VIEWS = {"filing": FILING, "period": PERIOD, "issuer": ISSUER, "fact": FACT, "form_ap": FORM_AP, "amended_text": DOCUMENT}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(*names: str) -> str:
    """The views as common table expressions of DuckDB."""
    return ", ".join(f"{n} AS ({VIEWS[n].format(s='VARCHAR')})" for n in names)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sql = VIEWS[name].format(s="STRING")
    for t in TABLES:
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            sql = sql.replace(f"FROM {t}", f"FROM parquet.`{sf}/{t}.parquet`").replace(f"JOIN {t}", f"JOIN parquet.`{sf}/{t}.parquet`")
    out = spark.sql(sql)
    # date_trunc gives a timestamp with a zone; the lake's are naive
    return out.select(*(out[c].cast("timestamp_ntz").alias(c) if t == "timestamp" else out[c] for c, t in out.dtypes))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its oracle."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add
