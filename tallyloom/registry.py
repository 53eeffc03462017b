"""The registry of queries and their DuckDB twins, and the SQL that both sides' inputs start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CASES = "\n".join(f"WHEN regexp_matches(upper(description), '{p}') THEN '{n}'" for n, p in rules.CATEGORIES)
SQL_ROWS = f"""WITH base AS (
 SELECT strftime(o_orderdate, '%Y-%m') || '/' || (o_custkey // 100) doc_id, o_orderkey idx, CAST(o_orderdate AS DATE) date,
  concat_ws(' ', c_mktsegment, CASE o_orderkey % 5 WHEN 0 THEN 'UBER' WHEN 1 THEN 'PADARIA' WHEN 2 THEN 'NETFLIX' END, c_name) description,
  CAST(o_totalprice AS DECIMAL(18,2)) amount_brl, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'BRL' END currency,
  0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE confidence, 0.6::DOUBLE + (o_orderkey % 3) / 10.0::DOUBLE pipeline_confidence,
  ['textract', 'azure', 'pdfplumber', 'camelot'][o_orderkey % 4 + 1] extractor
 FROM orders JOIN customer ON o_custkey = c_custkey),
rows AS (SELECT *, CASE {CASES} ELSE 'OUTROS' END category FROM base),
second AS (SELECT * REPLACE (CASE WHEN idx % 13 = 0 THEN date + 1 ELSE date END AS date, CAST(amount_brl + CASE WHEN idx % 11 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS amount_brl) FROM rows WHERE idx % 7 <> 0),
golden1 AS (SELECT * REPLACE (CASE WHEN idx % 17 = 0 THEN 'OUTROS' ELSE category END AS category) FROM rows WHERE idx % 6 <> 0),
golden AS (SELECT * FROM golden1 UNION ALL SELECT * FROM golden1 WHERE idx % 97 = 0),
lines AS (SELECT doc_id, idx line_no, strftime(date, '%d/%m') || ' ' || description || CASE WHEN idx % 9 = 0 THEN ' 10,00 ' ELSE ' ' END || translate(format('{{:,.2f}}', amount_brl::DOUBLE), ',.', '.,') line FROM rows),
runs AS (SELECT event_id run_id, ts, user_id doc_id, event_type AS method, event_id % 10 <> 0 success, (event_id % 100) / 100.0::DOUBLE confidence, round(value, 4) time_ms, event_id % 7 + 1 pages, CASE WHEN event_id % 10 = 0 THEN 'E' || (event_id % 30) END error FROM events)
"""


#: Rows with city, rate and card, their labels, and table rows of line items.
SQL_FULL = """, wide AS (SELECT *, CASE idx % 3 WHEN 0 THEN 'SAO PAULO' WHEN 1 THEN 'RIO' END merchant_city, CASE WHEN currency <> 'BRL' THEN CAST(5 + (idx % 10) / 10.0 AS DECIMAL(12,6)) END fx_rate, lpad((idx % 10000)::VARCHAR, 4, '0') card_last4 FROM rows),
labels1 AS (SELECT * REPLACE (CASE WHEN idx % 29 = 0 THEN lower(CASE WHEN idx % 17 = 0 THEN 'OUTROS' ELSE category END) WHEN idx % 17 = 0 THEN 'OUTROS' ELSE category END AS category,
  CASE WHEN idx % 19 = 0 THEN left(description, length(description) - 3) WHEN idx % 23 = 0 THEN 'X' || substr(description, 2) ELSE description END AS description,
  CASE WHEN idx % 31 = 0 THEN 'SAO PAULO SP' ELSE merchant_city END AS merchant_city, CAST(CASE WHEN idx % 37 = 0 THEN fx_rate + 0.005 WHEN idx % 41 = 0 THEN fx_rate + 0.02 ELSE fx_rate END AS DECIMAL(12,6)) AS fx_rate,
  CASE WHEN idx % 43 <> 0 THEN card_last4 END AS card_last4) FROM wide WHERE idx % 6 <> 0),
labelled AS (SELECT * FROM labels1 UNION ALL SELECT * FROM labels1 WHERE idx % 97 = 0)"""
SQL_ITEMS = """items AS (SELECT l_suppkey doc_id, l_orderkey table_idx, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_returnflag, l_quantity, l_discount, l_tax) + 1 row_idx,
 CAST(l_shipdate AS DATE) AS day, 'ITEM ' || translate(l_partkey::VARCHAR, '0123456789', 'abcdefghij') || ' ' || l_returnflag AS text, CAST(l_extendedprice AS DECIMAL(18,2)) amount FROM lineitem)"""


def query(sql: str | None = None, rows: bool = True):
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (SQL_ROWS if rows else "") + sql
        return f

    return register


def num(sql: str) -> str:
    """SQL for decimal text with a comma and thousands points as a number."""
    return f"TRY_CAST(replace(replace({sql}, '.', ''), ',', '.') AS DECIMAL(38,6))"
