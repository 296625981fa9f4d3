"""The parsed queries as a table that is built once, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.functions.text import TOKEN, fold_sql, tokens_sql
from vitrine.operators import understand as U
from vitrine.plans.common import table
from vitrine.sources.derived import derived


def parsed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every query with all that the parser finds."""
    inputs = [f"{sf}/query_records.parquet", f"{sf}/products.parquet"]
    return derived(spark, "parsed", inputs, lambda: U.parse(table(spark, sf, "query_records").select("query_id", "query"), "query_id", "query", table(spark, sf, "products")))


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _dict(values: dict) -> str:
    return f"MAP({_list(values)}, {_list(values.values())})"


_UNITS, _SPELL = _dict(U.UNITS), _dict(U.SPELLING)
_MODEL = "regexp_matches(x, '(?i)^[a-z0-9]+([-_.][a-z0-9]+)*$') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')"
_KEEP = _list(U.NEGATIONS + U.COMPATIBILITY + tuple(U.UNITS))
PARSED = f"""
pq0 AS (SELECT query_id, query, trim(regexp_replace({fold_sql("query", False)}, '\\s+', ' ', 'g')) AS normalized FROM query_records),
pq1 AS (SELECT *, coalesce(list_transform(regexp_extract_all(normalized, '{TOKEN.replace(chr(39), chr(39) * 2)}'), lambda x: coalesce({_SPELL}[x], x)), []) AS tokens FROM pq0),
pq2 AS (SELECT *, array_to_string(tokens, ' ') AS joined, list_sort(list_distinct(list_filter(tokens, lambda x: {_MODEL}))) AS models FROM pq1),
pq AS (SELECT *,
  list_filter(string_split_regex(joined, '[ ''-]'), lambda x: regexp_full_match(x, '\\d+')) AS plain_numbers,
  list_sort(list_distinct(list_filter(list_transform(tokens, lambda x: {_UNITS}[x]), lambda x: x IS NOT NULL))) AS units,
  list_sort(list_distinct(list_filter(list_transform(range(1, len(tokens)), lambda i: CASE WHEN regexp_full_match(tokens[i], '\\d+(\\.\\d+)?') THEN tokens[i] || ' ' || {_UNITS}[tokens[i + 1]] END), lambda x: x IS NOT NULL))) AS measurements,
  list_sort(list_intersect(tokens, {_list(U.COMPATIBILITY)})) AS compatibility,
  list_filter({_list(U.COMPATIBILITY_PHRASES)}, lambda p: contains(joined, p)) AS compatibility_phrases,
  list_sort(list_intersect(tokens, {_list(U.NEGATIONS)})) AS negations,
  list_filter(tokens, lambda x: NOT list_contains({_list(U.STOPWORDS)}, x) OR list_contains({_KEEP}, x) OR list_contains(models, x)) AS kept,
  CASE WHEN query IS NULL THEN 'null' WHEN length(query) > 512 OR strlen(query) > 2048 THEN 'too_long' WHEN normalized = '' THEN 'empty' WHEN len(tokens) = 0 THEN 'no_tokens' WHEN len(tokens) > 64 THEN 'too_many_tokens' END AS problem
  FROM pq2)"""


def _dictionary(name: str, column: str, least: int) -> str:
    return f"""{name} AS (SELECT gram, value FROM (SELECT value, array_to_string({tokens_sql("value", False)}, ' ') AS gram FROM (SELECT DISTINCT {column} AS value FROM products WHERE length({column}) >= {least})) WHERE gram <> ''
  QUALIFY row_number() OVER (PARTITION BY gram ORDER BY length(value) DESC, value) = 1)"""


_ALIAS = f"""alias AS (SELECT gram, value FROM (SELECT unnest({_list(U.COLOR_ALIASES)}) AS gram, unnest({_list(U.COLOR_ALIASES.values())}) AS value) WHERE value IN (SELECT normalized_color FROM products))"""
_HITS = """brand_hit AS (SELECT query_id, value AS brand FROM grams JOIN brands USING (gram) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, s) = 1),
color_hit AS (SELECT query_id, value AS color FROM grams JOIN colors USING (gram) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, s) = 1),
alias_hit AS (SELECT query_id, value AS color FROM grams JOIN alias USING (gram) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, s) = 1)"""
_GRAMS = """widest AS (SELECT least(64, max(len(string_split(gram, ' ')))) AS most FROM (SELECT gram FROM brands UNION ALL SELECT gram FROM colors UNION ALL SELECT gram FROM alias)),
spans AS (SELECT query_id, tokens, unnest(range(1, least(len(tokens), most) + 1)) AS w FROM pq, widest),
spots AS (SELECT query_id, tokens, w, unnest(range(1, len(tokens) - w + 2)) AS s FROM spans),
grams AS (SELECT query_id, w, s, array_to_string(tokens[s:s + w - 1], ' ') AS gram FROM spots)"""
ENTITIES = f"{PARSED}, {_dictionary('brands', 'normalized_brand', 2)}, {_dictionary('colors', 'normalized_color', 1)}, {_ALIAS}, {_GRAMS}, {_HITS}"


def digest_sql(rows: str, group: str, key: str) -> str:
    """``{rows}_digest``(group, keys, digest): the hash of hashes of the keys of each group."""
    return f"""{rows}_h AS (SELECT {group}, sha256(CAST({key} AS VARCHAR)) AS h FROM {rows}),
{rows}_p AS (SELECT {group}, substr(h, 1, 3) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM {rows}_h GROUP BY ALL),
{rows}_digest AS (SELECT {group}, CAST(sum(n) AS BIGINT) AS keys, sha256(string_agg(d, '' ORDER BY p)) AS digest FROM {rows}_p GROUP BY {group})"""
