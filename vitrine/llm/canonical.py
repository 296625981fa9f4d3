"""Freely entered values mapped to a reference list: a partition-based pigeonhole join, in SQL only.

A reference string is cut into k + 1 segments. A string within k edits of it must hold one segment unchanged,
shifted by at most k places. So an equality join of reference segments with positional substrings of the
entered values finds every pair within k edits; the built-in ``levenshtein`` verifies them. Values without
a partner come out through an anti-join. Work is done once per distinct value, never per row.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

#: A value may differ from a reference string in so many edits: (from this many characters on, edits).
EDITS = ((0, 0), (4, 1), (12, 2))
#: Values that make up more than 1 / HEAVY of the rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 5_000


def _fold_pairs() -> tuple[str, str]:
    """Full-width forms, accented Latin letters and odd blanks with their plain forms, derived from Unicode."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x180), *range(0xFF01, 0xFF5F), 0xA0, 0x3000, 0x2009, 0x202F, 0x9, 0xA, 0xD]:
        c = chr(cp)
        plain = " " if c.isspace() else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            src.append(c)
            dst.append(plain)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_pairs()


def _quoted(text: str, spark: bool) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'") if spark else text.replace("'", "''")


def _sub(x: str, pattern: str, to: str, spark: bool) -> str:
    if spark:
        return f"regexp_replace({x}, '{pattern.replace(chr(92), chr(92) * 2)}', '{to.replace(chr(92), chr(92) * 2)}')"
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run ``sql`` in which ``{name}`` stands for a table; other braces are plain text."""
    for name in tables:
        sql = sql.replace("{" + name + "}", f"\0{name}\1")
    sql = sql.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return spark.sql(sql, **tables)


def fold_sql(x: str, spark: bool = True) -> str:
    """Lower case, plain Latin letters, single blanks."""
    f, t = _quoted(FOLD_FROM, spark), _quoted(FOLD_TO, spark)
    return f"trim({_sub(f'lower(translate({x}, ' + chr(39) + f + chr(39) + ', ' + chr(39) + t + chr(39) + '))', ' +', ' ', spark)})"


def squash_sql(x: str, spark: bool = True) -> str:
    return _sub(x, r"[^\p{L}\p{M}\p{N}ー]+", "", spark)


#: What people write around a maker's name.
BRAND_LEAD = r"^(brand|marca|maker|visit the|from|by)[ :]+"
BRAND_TAIL = r"([ ,]+(inc|llc|ltd|gmbh|corp|s\.a|co\., ltd|co|kk|store)\.?|[ ]*(\(tm\)|™|®|©))$"
BRAND_AND = r" +(&amp;|and|y|et|und|&) +"
#: What people write around a colour: finish words, labels and pack notes.
COLOR_LEAD = r"^(color|colour|matte|glossy|metallic|brushed|solid|satin)[ :]+"
COLOR_TAIL = r"([ ]+(matte|satin|glossy|metallic|brushed|solid)|[ ]*\([0-9]+ pack\)|[.])$"


def brand_key_sql(x: str, spark: bool = True) -> str:
    """The brand without labels, legal forms and marks, as letters and digits only; a zero counts as an o."""
    y = _sub(_sub(_sub(fold_sql(x, spark), BRAND_LEAD, "", spark), BRAND_TAIL, "", spark), BRAND_TAIL, "", spark)
    # letters set apart are one word, in which a y is no "and"
    apart = f"regexp_like({y}, '^(\\\\S )+\\\\S$')" if spark else f"regexp_matches({y}, '^(\\S )+\\S$')"
    y = f"CASE WHEN {apart} THEN {y} ELSE {_sub(y, BRAND_AND, ' ', spark)} END"
    return f"translate({squash_sql(y, spark)}, '0', 'o')"


def color_key_sql(x: str, spark: bool = True) -> str:
    """The colour without finish words, labels and pack notes; `a/a` counts as `a`."""
    y = _sub(_sub(_sub(fold_sql(x, spark), COLOR_LEAD, "", spark), COLOR_TAIL, "", spark), COLOR_LEAD, "", spark)
    half = f"split({y}, '/')" if spark else f"string_split({y}, '/')"
    first, second = (f"{half}[0]", f"{half}[1]") if spark else (f"{half}[1]", f"{half}[2]")
    size = "size" if spark else "len"
    return squash_sql(f"CASE WHEN {size}({half}) = 2 AND trim({first}) = trim({second}) THEN trim({first}) ELSE {y} END", spark)


def edits_sql(length: str) -> str:
    whens = " ".join(f"WHEN {length} >= {n} THEN {k}" for n, k in sorted(EDITS, reverse=True))
    return f"CASE {whens} ELSE 0 END"


_MATCH = """
WITH vals AS (SELECT DISTINCT val_key, char_length(val_key) AS vlen FROM {entered} WHERE val_key <> ''),
refs AS (SELECT DISTINCT entry_id, ref_key, char_length(ref_key) AS rlen, {k_ref} AS k FROM {reference} WHERE ref_key <> ''),
cuts AS (
  SELECT entry_id, ref_key, rlen, k, i, CAST(floor(i * rlen / (k + 1)) AS INT) AS at,
         CAST(floor((i + 1) * rlen / (k + 1)) AS INT) - CAST(floor(i * rlen / (k + 1)) AS INT) AS width
  FROM refs LATERAL VIEW explode(sequence(0, k)) t AS i),
shapes AS (SELECT DISTINCT rlen, k, i, at, width FROM cuts),
spots AS (
  SELECT v.val_key, v.vlen, s.rlen, s.k, s.i, substring(v.val_key, s.at + 1 + d, s.width) AS piece
  FROM (SELECT val_key, vlen, explode(sequence(vlen - {k_max}, vlen + {k_max})) AS rlen FROM vals) v
  JOIN shapes s ON s.rlen = v.rlen AND abs(s.rlen - v.vlen) <= s.k
  LATERAL VIEW explode(sequence(-s.k, s.k)) t AS d
  WHERE s.at + d >= 0 AND s.at + d + s.width <= v.vlen),
pairs AS (
  SELECT DISTINCT p.val_key, c.entry_id, c.ref_key, c.k
  FROM spots p JOIN cuts c ON c.rlen = p.rlen AND c.i = p.i AND substring(c.ref_key, c.at + 1, c.width) = p.piece),
near AS (SELECT val_key, entry_id, min(levenshtein(val_key, ref_key)) AS edits FROM pairs WHERE levenshtein(val_key, ref_key) <= k GROUP BY val_key, entry_id),
best AS (SELECT val_key, min_by(entry_id, struct(edits, entry_id)) AS entry_id, min(edits) AS edits, array_sort(collect_list(struct(edits, entry_id))) AS all_near FROM near GROUP BY val_key)
SELECT val_key, entry_id, edits, transform(filter(all_near, x -> x.edits = edits), x -> x.entry_id) AS entries FROM best
"""


def match_values(entered: DataFrame, reference: DataFrame) -> DataFrame:
    """(val_key, entry_id, edits, entries): the closest reference entry of each distinct key, where there is one.

    ``entered`` has ``val_key``, ``reference`` has ``entry_id`` and ``ref_key`` (an entry may have several).
    Closest is fewest edits, then the smallest id; ``entries`` has all that are as close, so a key with several is
    ambiguous. Empty and null keys match nothing. The allowed edits grow
    with the length of the reference string (:data:`EDITS`).
    """
    k_max = max(k for _, k in EDITS)
    sql = _MATCH.replace("{k_ref}", edits_sql("char_length(ref_key)")).replace("{k_max}", str(k_max))
    return run_sql(entered.sparkSession, sql, entered=entered, reference=reference)


def map_column(rows: DataFrame, id_column: str, column: str, key_sql, reference: DataFrame) -> DataFrame:
    """(id, val, entry_id) of every row with a non-null value; ``entry_id`` is 0 where no entry is meant.

    ``key_sql(column_sql)`` gives the comparison key. Other columns of ``rows`` do not matter. Repeated rows
    stay repeated; an empty table gives an empty result; a value that folds to nothing is unmatched.
    """
    spark = rows.sparkSession
    from vitrine.scratch import materialize

    entered = run_sql(spark, f"SELECT {column} AS val, {key_sql(column)} AS val_key, count(*) AS rows FROM {{rows}} WHERE {column} IS NOT NULL GROUP BY ALL", rows=rows)
    entered = materialize(entered, "entered")
    matched = materialize(match_values(entered, reference), "matched")
    found = run_sql(
        spark,
        """
        SELECT e.val, m.entry_id, e.rows FROM {entered} e JOIN {matched} m ON m.val_key = e.val_key
        UNION ALL
        SELECT e.val, CAST(0 AS BIGINT), e.rows FROM {entered} e LEFT ANTI JOIN {matched} m ON m.val_key = e.val_key""",
        entered=entered,
        matched=matched,
    )
    found = materialize(found, "mapping")
    return run_sql(
        spark,
        f"""
        WITH total AS (SELECT sum(rows) AS n FROM {{found}}),
        heavy AS (SELECT val, entry_id FROM {{found}}, total WHERE rows * {HEAVY} > n),
        light AS (SELECT val, entry_id FROM {{found}}, total WHERE rows * {HEAVY} <= n),
        some AS (SELECT {id_column}, {column} AS val FROM {{rows}} WHERE {column} IS NOT NULL),
        marked AS (SELECT /*+ BROADCAST(h) */ s.{id_column}, s.val, h.entry_id, h.val IS NOT NULL AS is_heavy FROM some s LEFT JOIN heavy h ON h.val = s.val)
        SELECT {id_column}, val, entry_id FROM marked WHERE is_heavy
        UNION ALL
        SELECT m.{id_column}, m.val, l.entry_id FROM marked m JOIN light l ON l.val = m.val WHERE NOT m.is_heavy""",
        found=found,
        rows=rows,
    )


def ambiguous(rows: DataFrame, column: str, key_sql, reference: DataFrame) -> DataFrame:
    """(val, edits, entries, rows_entered): entered values to which several entries are equally close."""
    spark = rows.sparkSession
    entered = run_sql(spark, f"SELECT {column} AS val, {key_sql(column)} AS val_key, count(*) AS rows_entered FROM {{rows}} WHERE {column} IS NOT NULL GROUP BY ALL", rows=rows)
    matched = match_values(entered, reference)
    return run_sql(spark, "SELECT e.val, m.edits, m.entries, e.rows_entered FROM {entered} e JOIN {matched} m ON m.val_key = e.val_key WHERE size(m.entries) > 1", entered=entered, matched=matched)


def brand_reference(brands: DataFrame) -> DataFrame:
    """Each brand by its key and, for names of two words, by the key with the words swapped."""
    swapped = _sub("brand_name", r"^(\S+)\s+(?:&\s+)?(\S+)$", "$2 $1", True)
    return run_sql(
        brands.sparkSession,
        f"""SELECT brand_id AS entry_id, {brand_key_sql("brand_name")} AS ref_key FROM {{b}}
        UNION SELECT brand_id, {brand_key_sql(swapped)} FROM {{b}}""",
        b=brands,
    )


def color_reference(colors: DataFrame) -> DataFrame:
    """Each colour by its name and every other known name."""
    return run_sql(
        colors.sparkSession,
        f"""SELECT color_id AS entry_id, {color_key_sql("name")} AS ref_key FROM (
          SELECT color_id, color_name AS name FROM {{c}} UNION ALL SELECT color_id, explode(other_names) FROM {{c}})""",
        c=colors,
    )
