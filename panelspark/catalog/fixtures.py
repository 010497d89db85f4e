"""Panel tables derived from the supplied star-schema tables.

The bodies are one SQL text for both engines: Spark substitutes DataFrames for the ``{…}``
names, the oracle substitutes CTE names. Sums run over integer cents, so both engines start
from bit-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.sources.staging import stage

INDUSTRIES = 60
_HELD = ",\n  ".join(f"CASE WHEN CAST(barrid AS INT)%{INDUSTRIES}={i} THEN 1e0 ELSE 0e0 END AS IND{i}" for i in range(INDUSTRIES))
_NUMBERS = ", ".join(f"({i})" for i in range(INDUSTRIES))

BODIES = {
    "fx_cells": """
SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date,
  CAST(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) AS DOUBLE) AS cents,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty,
  CAST(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)*CAST(ROUND(l_discount*100) AS BIGINT)) AS DOUBLE) AS disc,
  CAST(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)*CAST(ROUND(l_tax*100) AS BIGINT)) AS DOUBLE) AS tax,
  MIN(l_linenumber) AS ln, MIN(l_orderkey) AS ok
FROM {lineitem} GROUP BY 1, 2""",
    "fx_assets": """
SELECT date, CAST(asset AS STRING) AS barrid, s_name AS ticker,
  cents/qty/1e4 AS price,
  CASE WHEN ok%101=0 THEN NULL ELSE (tax-disc)/cents+1e0 END AS {q}return{q},
  CASE WHEN qty=1e0 AND ln>=6 THEN 0e0 ELSE qty END AS daily_volume,
  cents/qty/1e4*CAST(asset*1000 AS DOUBLE) AS market_cap,
  tax/cents/1e2 AS bid_ask_spread,
  disc/cents-5e0 AS specific_return,
  CASE WHEN ok%97=0 THEN NULL ELSE 1e1+CAST((asset*13+ok)%30 AS DOUBLE) END AS specific_risk,
  CASE WHEN ok%89=0 THEN NULL ELSE 5e-1+CAST((asset*7+ok)%100 AS DOUBLE)/1e2 END AS predicted_beta,
  asset%20<>0 AS in_universe
FROM {fx_cells} JOIN {supplier} ON asset = s_suppkey""",
    "fx_market_daily": """
SELECT date, asset AS permno, CONCAT('C', CAST(asset AS STRING)) AS cusip, s_name AS ticker,
  CASE WHEN s_nationkey%3=0 THEN 'N' WHEN s_nationkey%3=1 THEN 'A' ELSE 'Q' END AS primaryexch,
  'EQTY' AS securitytype,
  CASE WHEN ok%101=0 THEN NULL ELSE ((tax-disc)/cents+1e0)/1e2 END AS ret,
  CASE WHEN ok%53=0 THEN -cents/qty/1e4 ELSE cents/qty/1e4 END AS prc,
  CASE WHEN qty=1e0 AND ln>=6 THEN 0e0 ELSE qty END AS vol,
  CAST(asset*1000 AS DOUBLE) AS shrout
FROM {fx_cells} JOIN {supplier} ON asset = s_suppkey""",
    "fx_exposures": """
SELECT date, CAST(asset AS STRING) AS barrid,
  (qty-25e0)/25e0 AS USSLOWL_LIQUIDTY,
  CASE WHEN ok%83=0 THEN NULL ELSE disc/cents-5e0 END AS USSLOWL_EARNQLTY,
  tax/cents-4e0 AS USSLOWL_VALUE,
  CAST((asset*11+ok)%21-10 AS DOUBLE)/1e1 AS USSLOWL_PROFIT,
  CAST((asset*5+ok)%21-10 AS DOUBLE)/1e1 AS USSLOWL_MIDCAP,
  CASE WHEN asset%7=0 THEN 1e0 ELSE 0e0 END AS USSLOWL_AIRLINES
FROM {fx_cells}""",
    "fx_factors": """
SELECT CAST(o_orderdate AS DATE) AS date,
  CAST(SUM(CASE WHEN o_orderstatus='F' THEN 1 ELSE -1 END) AS DOUBLE)/COUNT(*)/1e2 AS mkt_rf,
  CAST(SUM(CASE WHEN o_orderpriority<'3' THEN 1 ELSE -1 END) AS DOUBLE)/COUNT(*)/2e2 AS smb,
  CAST(SUM(o_orderkey%7-3) AS DOUBLE)/COUNT(*)/1e3 AS hml,
  CAST(SUM(o_custkey%5-2) AS DOUBLE)/COUNT(*)/1e3 AS rmw,
  CAST(SUM(o_custkey%11-5) AS DOUBLE)/COUNT(*)/1e3 AS cma,
  CAST(COUNT(*) AS DOUBLE)/1e6 AS rf
FROM {orders} GROUP BY 1""",
    # Our definition: a rank-one part from the day's factor returns plus a fixed diagonal,
    # in squared percent, upper triangle only.
    "fx_covariances": """
SELECT date, 'USSLOWL_EARNQLTY' AS factor_1, 'USSLOWL_EARNQLTY' AS factor_2, 1e4*mkt_rf*mkt_rf+4e0 AS covariance FROM {fx_factors}
UNION ALL SELECT date, 'USSLOWL_EARNQLTY', 'USSLOWL_PROFIT', 1e4*mkt_rf*smb FROM {fx_factors}
UNION ALL SELECT date, 'USSLOWL_EARNQLTY', 'USSLOWL_VALUE', 1e4*mkt_rf*hml FROM {fx_factors}
UNION ALL SELECT date, 'USSLOWL_PROFIT', 'USSLOWL_PROFIT', 1e4*smb*smb+9e0 FROM {fx_factors}
UNION ALL SELECT date, 'USSLOWL_PROFIT', 'USSLOWL_VALUE', 1e4*smb*hml FROM {fx_factors}
UNION ALL SELECT date, 'USSLOWL_VALUE', 'USSLOWL_VALUE', 1e4*hml*hml+1e0 FROM {fx_factors}""",
    # Our definition: every asset has one of sixty industries besides its three styles.
    "fx_industries": f"""
SELECT date, barrid, USSLOWL_EARNQLTY, USSLOWL_PROFIT, USSLOWL_VALUE,
  {_HELD}
FROM {{fx_exposures}}""",
    # Our definition: matrices on the first factor date of a month, industries with a variance.
    "fx_month_starts": """
SELECT MIN(date) AS date FROM {fx_factors} GROUP BY date_trunc('month', date)""",
    "fx_covariances_monthly": f"""
SELECT c.date, factor_1, factor_2, covariance FROM {{fx_covariances}} c JOIN {{fx_month_starts}} m ON m.date = c.date
UNION ALL SELECT date, CONCAT('IND', CAST(i AS STRING)), CONCAT('IND', CAST(i AS STRING)), 2e0 + CAST(i AS DOUBLE)/3e1
FROM {{fx_month_starts}} CROSS JOIN (VALUES {_NUMBERS}) AS v(i)""",
}

DEPENDS = {
    "fx_cells": ["lineitem"],
    "fx_assets": ["fx_cells", "supplier"],
    "fx_market_daily": ["fx_cells", "supplier"],
    "fx_exposures": ["fx_cells"],
    "fx_factors": ["orders"],
    "fx_covariances": ["fx_factors"],
    "fx_industries": ["fx_exposures"],
    "fx_month_starts": ["fx_factors"],
    "fx_covariances_monthly": ["fx_covariances", "fx_month_starts"],
}


def oracle_body(name: str) -> str:
    """The view body for an engine that quotes identifiers with double quotes."""
    body = BODIES[name].replace("{q}", '"')
    return body.format(**{d: d for d in DEPENDS[name]})


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table or a derived panel as a DataFrame."""
    if name not in BODIES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {d: frame(spark, sf_dir, d) for d in DEPENDS[name]}
    if name == "fx_covariances":
        inputs = {d: stage(df) for d, df in inputs.items()}  # read once per branch
    return spark.sql(BODIES[name].replace("{q}", "`"), **inputs)
