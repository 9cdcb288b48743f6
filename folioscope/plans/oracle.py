"""Shared parts of the SQL that queries are compared with.

The star corpus is checked against the foreign keys and the planting rules it was
written from, not by parsing its pages a second time, wherever that is possible.
"""

from __future__ import annotations

from folioscope.functions.text import STOPWORDS
from folioscope.sources.adapters import RAW_FILES, star_sql

STAR = f"star AS MATERIALIZED ({star_sql('duckdb')})"

_SUP, _NAT, _CUS, _REG = (f"'wiki/{p}-' || {k} || '.md'" for p, k in (("concepts/supplier", "s_suppkey"), ("entities/nation", "n_nationkey"), ("customers/customer", "c_custkey"), ("regions/region", "r_regionkey")))
_SN, _CN = "'/entities/nation-' || s_nationkey || '.md'", "'/entities/nation-' || c_nationkey || '.md'"

#: Every link of the corpus by the rule that planted it.
LINKS = f"""links AS MATERIALIZED (
 SELECT {_SUP} AS page_id, {_SN} AS href FROM supplier UNION ALL SELECT {_SUP}, {_SN} FROM supplier
 UNION ALL SELECT {_SUP}, {_SN} FROM supplier WHERE s_suppkey % 4 = 0
 UNION ALL SELECT {_SUP}, '/missing/m' || (s_suppkey % 3) || '.md' FROM supplier WHERE s_suppkey % 7 = 0
 UNION ALL SELECT {_SUP}, 'wiki' || {_SN} FROM supplier WHERE s_suppkey % 5 = 0
 UNION ALL SELECT {_SUP}, 'entities/nation-' || s_nationkey || '.md' FROM supplier WHERE s_suppkey % 10 = 3
 UNION ALL SELECT {_SUP}, '..' || {_SN} FROM supplier WHERE s_suppkey % 11 = 1
 UNION ALL SELECT {_CUS}, {_CN} FROM customer UNION ALL SELECT {_CUS}, {_CN} FROM customer
 UNION ALL SELECT {_CUS}, '/concepts/supplier-' || (c_custkey % 40) || '.md' FROM customer
 UNION ALL SELECT {_NAT}, '/regions/region-' || n_regionkey || '.md' FROM nation
 UNION ALL SELECT {_REG}, '/entities/nation-' || r_regionkey || '.md' FROM region
 UNION ALL SELECT 'wiki/index.md', '/entities/nation-' || n_nationkey || '.md' FROM nation WHERE n_nationkey % 5 <> 4
 UNION ALL SELECT 'wiki/index.md', '/concepts/supplier-' || s_suppkey || '.md' FROM supplier WHERE s_suppkey % 3 <> 0)"""
TARGETS = """targets AS MATERIALIZED (SELECT page_id, href, CASE WHEN href LIKE '/%' THEN 'wiki' || href WHEN href LIKE '../%' THEN NULL WHEN href LIKE 'wiki/%' THEN href ELSE 'wiki/' || href END AS t FROM links)"""
EDGES = f"""edges AS MATERIALIZED (
 SELECT x.page_id AS s, x.t, 'links_to' AS k, count(*) AS w FROM targets x JOIN star p ON p.page_id = x.t WHERE x.page_id <> x.t GROUP BY 1, 2
 UNION ALL SELECT {_SUP}, 'wiki' || {_SN}, 'derived_from', 1 FROM supplier)"""
GRAPH = f"{STAR}, {LINKS}, {TARGETS}, {EDGES}"
BOTH = "both_ways AS MATERIALIZED (SELECT s AS a, t AS b FROM edges UNION SELECT t, s FROM edges)"
DEGREES = """deg AS MATERIALIZED (SELECT page_id, CAST(coalesce(i, 0) AS BIGINT) AS inbound, CAST(coalesce(o, 0) AS BIGINT) AS outbound FROM star
 LEFT JOIN (SELECT t, count(DISTINCT s || k) AS i FROM edges GROUP BY 1) a ON a.t = page_id LEFT JOIN (SELECT s, count(DISTINCT t || k) AS o FROM edges GROUP BY 1) b ON b.s = page_id)"""
FILES = "files AS MATERIALIZED (SELECT page_id AS path FROM star UNION ALL " + " UNION ALL ".join(f"SELECT '{p}'" for p in RAW_FILES) + ")"
LINES = f"""{STAR}, split AS MATERIALIZED (SELECT page_id, string_split(body, chr(10)) AS a FROM star),
 lines AS MATERIALIZED (SELECT page_id, unnest(generate_series(1, len(a))) AS line_no, unnest(a) AS line FROM split)"""
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
WORD = "[a-z0-9][a-z0-9_.+-]*"


def tokens(source: str, text: str) -> str:
    """A CTE body (page_id, token), a row for each occurrence."""
    return f"SELECT page_id, token FROM (SELECT page_id, unnest(regexp_extract_all(lower({text}), '{WORD}')) AS token FROM {source}) WHERE length(token) >= 2 AND token NOT IN ({STOP})"
