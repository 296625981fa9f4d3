"""Deterministic query understanding as a DataFrame pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import TOKEN, fold_sql, sql_literal
from vitrine.operators.foundation import content_digest
from vitrine.operators.skewjoin import shuffled
from vitrine.scratch import materialize
from vitrine.sources.sinks import json_digest

PARSER_VERSION = "v2"

#: Unit spellings.
UNITS = {
    "centimeter": "cm",
    "centimeters": "cm",
    "cm": "cm",
    "foot": "ft",
    "feet": "ft",
    "ft": "ft",
    "gigabyte": "gb",
    "gigabytes": "gb",
    "gb": "gb",
    "inch": "in",
    "inches": "in",
    "in": "in",
    "kilogram": "kg",
    "kilograms": "kg",
    "kg": "kg",
    "liter": "l",
    "liters": "l",
    "litre": "l",
    "litres": "l",
    "l": "l",
    "megabyte": "mb",
    "megabytes": "mb",
    "mb": "mb",
    "millimeter": "mm",
    "millimeters": "mm",
    "mm": "mm",
    "ounce": "oz",
    "ounces": "oz",
    "oz": "oz",
    "pound": "lb",
    "pounds": "lb",
    "lb": "lb",
    "terabyte": "tb",
    "terabytes": "tb",
    "tb": "tb",
}
#: Word lists of the parser.
COMPATIBILITY = ("compatible", "compatibility", "fits", "fit", "replacement", "works", "with", "for")
COMPATIBILITY_PHRASES = ("compatible with", "fits", "replacement for", "works with")
NEGATIONS = ("no", "not", "without", "never")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "from", "is", "it", "of", "on", "or", "the", "to")
SPELLING = {"bluetooths": "bluetooth", "headfone": "headphone", "headfones": "headphones", "wireles": "wireless"}
COLOR_ALIASES = {"aqua": "blue", "charcoal": "gray", "grey": "gray", "navy blue": "navy"}
#: Bounds of a query.
MAX_CHARS, MAX_BYTES, MAX_TOKENS = 512, 2048, 64
NUMBER = r"(?<!\w)\d+(?:\.\d+)?(?!\w)"


def _strings(values) -> str:
    return f"array({', '.join(sql_literal(v) for v in values)})"


def _map(values: dict) -> str:
    return f"map({', '.join(f'{sql_literal(k)}, {sql_literal(v)}' for k, v in values.items())})"


def parse_tokens(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query_id`` and the parts of each query: ``normalized``, ``tokens`` (spelling corrected), ``numbers``,
    ``units``, ``measurements``, ``models``, ``compatibility``, ``compatibility_phrases``, ``negations``,
    ``reduced``, ``corrected`` and ``problem``.

    ``problem`` is null for a good query, else the bound it breaks: null, empty, too_long, no_tokens or
    too_many_tokens; such rows keep what could be parsed.
    """
    pattern = TOKEN.replace("\\", "\\\\")
    has = lambda x, values: f"array_contains({_strings(values)}, {x})"
    units = _map(UNITS)
    model = "x RLIKE '(?i)^[a-z0-9]+([-_.][a-z0-9]+)*$' AND x RLIKE '[a-z]' AND x RLIKE '[0-9]'"
    steps = {
        "normalized": f"trim(regexp_replace({fold_sql(text)}, '\\\\s+', ' '))",
        "_first": f'coalesce(regexp_extract_all(normalized, "{pattern}", 0), array())',
        "tokens": f"transform(_first, x -> coalesce({_map(SPELLING)}[x], x))",
        "corrected": "_first <> tokens",
        "_joined": "array_join(tokens, ' ')",
        "numbers": f"regexp_extract_all(_joined, '{NUMBER.replace(chr(92), chr(92) * 2)}', 0)",
        "units": f"array_sort(array_distinct(array_compact(transform(tokens, x -> {units}[x]))))",
        "measurements": f"array_sort(array_distinct(array_compact(transform(tokens, (x, i) -> CASE WHEN x RLIKE '^\\\\d+(\\\\.\\\\d+)?$' AND i + 1 < size(tokens) THEN concat(x, ' ', {units}[tokens[i + 1]]) END))))",
        "models": f"array_sort(array_distinct(filter(tokens, x -> {model})))",
        "compatibility": f"array_sort(array_intersect(tokens, {_strings(COMPATIBILITY)}))",
        "compatibility_phrases": f"filter({_strings(COMPATIBILITY_PHRASES)}, p -> contains(_joined, p))",
        "negations": f"array_sort(array_intersect(tokens, {_strings(NEGATIONS)}))",
        "_reduced": f"filter(tokens, x -> NOT {has('x', STOPWORDS)} OR {has('x', NEGATIONS + COMPATIBILITY + tuple(UNITS))} OR array_contains(models, x))",
        "reduced": "CASE WHEN size(_reduced) = 0 THEN tokens ELSE _reduced END",
        "problem": f"""CASE WHEN {text} IS NULL THEN 'null' WHEN char_length({text}) > {MAX_CHARS} OR octet_length({text}) > {MAX_BYTES} THEN 'too_long' WHEN normalized = '' THEN 'empty'
            WHEN size(tokens) = 0 THEN 'no_tokens' WHEN size(tokens) > {MAX_TOKENS} THEN 'too_many_tokens' END""",
    }
    out = queries.select(query_id, text)
    for name, sql in steps.items():
        out = out.withColumn(name, F.expr(sql))
    return out.drop(text, "_first", "_joined", "_reduced")


def dictionary(values: DataFrame, value: str, least_chars: int = 1) -> DataFrame:
    """``gram`` (tokens joined by blanks), ``value``, ``width``: one value per token sequence, the longest, then first."""
    pattern = TOKEN.replace("\\", "\\\\")
    rows = values.filter(F.char_length(value) >= least_chars).select(F.col(value).alias("value")).distinct()
    rows = rows.withColumn("_t", F.expr(f'regexp_extract_all({fold_sql("value")}, "{pattern}", 0)')).filter(F.size("_t") > 0)
    rows = rows.select(F.array_join("_t", " ").alias("gram"), F.size("_t").alias("width"), "value")
    return rows.groupBy("gram", "width").agg(F.min_by("value", F.struct((-F.char_length("value")).alias("n"), F.col("value").alias("v"))).alias("value"))


def entries(products: DataFrame) -> DataFrame:
    """``kind`` (brand, color, alias), ``gram``, ``width``, ``value``: what the parser knows, fitted on the catalogue.

    Brands have at least two characters; an alias counts if its canonical colour is in the catalogue.
    """
    of = {"brand": dictionary(products, "normalized_brand", 2), "color": dictionary(products, "normalized_color"), "alias": alias_entries(products, "normalized_color")}
    parts = [d.select(F.lit(kind).alias("kind"), "gram", "width", "value") for kind, d in of.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def longest_matches(parsed: DataFrame, query_id: str, known: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``query_id`` and a column per kind: the entry with the most tokens, then the earliest start, in each query.

    Windows go up to the widest entry that there is (a query has at most MAX_TOKENS tokens). All kinds are found by
    one join and one group-by; a query has at most width * MAX_TOKENS windows.
    """
    widest = min(known.agg(F.max("width")).first()[0] or 0, MAX_TOKENS)
    grams = F.expr(
        f"flatten(transform(sequence(1, greatest(1, least({widest}, size(tokens)))), w -> CASE WHEN w > size(tokens) THEN array() ELSE transform(sequence(0, size(tokens) - w), s -> named_struct('gram', array_join(slice(tokens, s + 1, w), ' '), 'start', s)) END))"
    )
    exploded = parsed.select(query_id, F.explode(grams).alias("g")).select(query_id, "g.gram", "g.start")
    hits = exploded.join(shuffled(known), "gram")
    best = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.struct((-F.col("width")).alias("w"), F.col("start"))))
    return hits.groupBy(query_id).agg(*[best(k).alias(k) for k in kinds])


def alias_entries(colors: DataFrame, color: str) -> DataFrame:
    """Alias entries whose canonical colour is in the catalog."""
    spark = colors.sparkSession
    rows = spark.createDataFrame([(a, len(a.split()), c) for a, c in COLOR_ALIASES.items()], "gram string, width int, value string")
    return rows.join(shuffled(colors.select(F.col(color).alias("value")).distinct()), "value", "left_semi").select("gram", "width", "value")


def parse(queries: DataFrame, query_id: str, text: str, products: DataFrame) -> DataFrame:
    """The parts of each query plus ``brand``, ``color``, their confidences and ``color_source``; brands of at least
    two characters and colours come from ``products`` (normalized_brand, normalized_color)."""
    parsed = materialize(parse_tokens(queries, query_id, text), "parsed")
    found = longest_matches(parsed, query_id, materialize(entries(products), "entries"), ("brand", "color", "alias"))
    found = found.withColumnsRenamed({"color": "_catalog", "alias": "_alias"})
    out = parsed.join(shuffled(found), query_id, "left")
    source = F.when(F.col("_catalog").isNotNull(), "catalog").when(F.col("_alias").isNotNull(), "alias")
    confidence = F.when(F.col("_catalog").isNotNull(), 1.0).when(F.col("_alias").isNotNull(), 0.9).otherwise(0.0)
    return out.withColumns(
        {"color": F.coalesce("_catalog", "_alias"), "color_source": source, "color_confidence": confidence, "brand_confidence": F.when(F.col("brand").isNotNull(), 1.0).otherwise(0.0)}
    ).drop("_catalog", "_alias")


def parser_state(products: DataFrame) -> DataFrame:
    """One row, ``state``: a hash of everything the parser was fitted with: the digests of the catalogue's brands and
    colours (see :func:`content_digest`), the alias lists and the version."""
    names = products.select(F.lit("brands").alias("kind"), F.col("normalized_brand").alias("value")).filter(F.char_length("value") >= 2)
    names = names.unionByName(products.select(F.lit("colors").alias("kind"), F.col("normalized_color").alias("value")).filter("value <> ''")).distinct()
    digests = content_digest(names, "kind", "value").agg(*[F.max(F.when(F.col("kind") == k, F.col("digest"))).alias(k) for k in ("brands", "colors")])
    fixed = {"color_aliases": json_digest(COLOR_ALIASES), "parser_version": PARSER_VERSION, "spelling_aliases": json_digest(SPELLING)}
    document = F.struct("brands", F.lit(fixed["color_aliases"]).alias("color_aliases"), "colors", F.lit(PARSER_VERSION).alias("parser_version"), F.lit(fixed["spelling_aliases"]).alias("spelling_aliases"))
    return digests.select(F.sha2(F.to_json(document), 256).alias("state"))


def query_hash(parsed: DataFrame, query_id: str, state: DataFrame) -> DataFrame:
    """``query_id``, ``query_sha256``: hash of the canonical JSON of the text, the parser's state and its version."""
    document = F.struct(F.col("normalized").alias("normalized_text"), F.col("state").alias("parser_state_sha256"), F.lit(PARSER_VERSION).alias("parser_version"))
    return parsed.crossJoin(F.broadcast(state)).select(query_id, F.sha2(F.to_json(document), 256).alias("query_sha256"))  # one row


def joined(col: Column | str) -> Column:
    return F.array_join(col, " ")
