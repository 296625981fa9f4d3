"""Listings that offer the same product, found by identifiers and guarded components.

From every listing come all standard identifiers (with a valid check digit), all part numbers, the brand, the
words of its title that name something, and the attributes that tell variants apart: size, pack count, version,
colour and, for an accessory, what part it is.

1. Part numbers and names are keys of a range: a part number belongs to the name that it most often stands with,
   a misspelt or padded name to the name it contains or nearly is, unless brand or part numbers contradict.
   Components of these keys are ranges. Titles fill in where a listing has no part number.
2. Listings of a range are the same product if their attributes agree; an unknown size or colour joins only where
   the range knows just one.
3. Listings that share a standard identifier are the same product whatever their ranges, unless attributes that
   both know contradict: such edges are cut. Components of what remains are products, and a component in which
   attributes contradict after all is cut once more by them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import canonical as C
from vitrine.llm.splits import components
from vitrine.operators.skewjoin import heavy_light_join
from vitrine.scratch import materialize, spread

#: A title word that stands with more than this part of a locale's part numbers, and with at least so many, is
#: vocabulary (what it is, how it is praised), not a name.
VOCABULARY, LEAST_NUMBERS = 0.004, 5
#: A word before "for" is a part if so many different things are named after it.
LEAST_WHOLES = 3
#: A name has at least so many letters.
NAME_LETTERS = 5
#: A name with at most so many listings may be another one misspelt.
RARE = 2
#: Listings of a product that one task pairs with each other.
PAIR_SLICE = 500
#: Sizes of a range that differ by less than this factor are one size (units are rounded).
SIZE_STEP = 1.03

#: Units by the dimension that they measure, with their size in the base unit.
UNITS = {
    "length": {"mm": 1, "cm": 10, "m": 1000, "in": 25.4, "inch": 25.4, "inches": 25.4, '"': 25.4, "″": 25.4, "ft": 304.8, "foot": 304.8, "feet": 304.8, "pulgadas": 25.4, "インチ": 25.4},
    "volume": {"ml": 1, "cl": 10, "l": 1000, "liter": 1000, "liters": 1000, "litre": 1000, "litro": 1000, "litros": 1000, "fl oz": 29.5735, "リットル": 1000},
    "mass": {"g": 1, "kg": 1000, "lb": 453.592, "lbs": 453.592, "pound": 453.592, "pounds": 453.592, "gramos": 1, "キロ": 1000},
    "ounce": {"oz": 1, "ounce": 1, "ounces": 1},
    "power": {"w": 1, "watt": 1, "watts": 1, "kw": 1000, "vatios": 1, "ワット": 1},
    "data": {"mb": 1, "gb": 1000, "tb": 1_000_000, "gigabyte": 1000, "gigabytes": 1000, "terabyte": 1_000_000, "terabytes": 1_000_000, "megabytes": 1},
}
_UNIT = {u: (d, f) for d, units in UNITS.items() for u, f in units.items()}
#: Words that sellers add to any title.
PROMOTION = frozenset(
    "new original professional grade perfect gift ultra premium hot sale great value deluxe limited offer edition best seller top rated satisfaction free shipping must have heavy duty upgraded envío gratis oferta nuevo el más vendido regalo ideal calidad the and with for".split()
)
_SIZE = re.compile(r"(?<![\w.,*<>$~/])(\d+(?:[.,]\d+)?)\s*-?\s*(fl\.?\s*oz|" + "|".join(sorted((re.escape(u) for u in _UNIT if u not in ('"', "″", "fl oz")), key=len, reverse=True)) + r")(?![\w])|(?<![\w.,*])(\d+(?:\.\d+)?)\s*[\"″]", re.I)
_PACK = re.compile(r"(?<!\[)\(?\b(?:(\d{1,3})\s*-?\s*(?:packs?|counts?|ct|pcs|pieces|piezas|unidades|個|枚)\b|(?:set|packs?|juego|paquete|box|lote) (?:of|de) (\d{1,3})\b)\)?(?!\])", re.I)
_VERSION = re.compile(r"\b(?:v|ver\.?|version|gen(?:eration)?\.?|mk\.?|mark)\s*-?(\d{1,2}|i{1,3}|iv|vi{0,3})\b|\b(\d{1,2})(?:st|nd|rd|th)\s+gen(?:eration)?\b", re.I)
_WORDS, _FOR, _BOXED = re.compile(r"[^\W_]+"), re.compile(r"\bfor\b", re.I), re.compile(r"\[[^\]]*\]")
_PART_NUMBER = re.compile(r"(?<![\w])([A-Za-z]{2,4})([-_ ]?)(\d{3,6})(?![\w])")
_NUMBER_SQL = r"\b([a-z]{2,4})[-_ ]?(\d{3,6})\b"
_GTIN = re.compile(r"(?<!\d)(\d{8}|\d{12,14})(?!\d)")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>|\\[a-z]+(?=[{ ])|[{}]", re.S | re.I)
#: What stands before a number in a text that is not the size of the product.
_NOT_SIZE = re.compile(r"(?:about|below|under|up to|above|over|from|standby|follows[^.]*|saves[^.]*)\s*$", re.I)
_CUE = r"(?:size|rated|measures up as|this listing is for|tamaño)\s*:?\s*$"


def plain(text: str | None) -> str:
    """NFKC without control characters, tags and entities; runs of blanks as one."""
    if not text:
        return ""
    import html

    for _ in range(2):
        if "&" not in text:
            break
        text = html.unescape(text)
    if "<" in text or "\\" in text or "{" in text or "}" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if not text.isprintable():
        text = "".join(c if c.isprintable() else " " for c in text)
    return " ".join(text.split())


def valid_gtin(digits: str) -> bool:
    """The check digit of an EAN-8, UPC-A, EAN-13 or GTIN-14; a run of one digit is none."""
    if len(set(digits)) < 3:
        return False
    total = sum(int(c) * (3 if k % 2 == 0 else 1) for k, c in enumerate(reversed(digits[:-1])))
    return (10 - total % 10) % 10 == int(digits[-1])


def gtins(text: str) -> list[str]:
    return sorted({m.zfill(14) for m in _GTIN.findall(text) if valid_gtin(m)})


def part_numbers(text: str) -> list[str]:
    """All part numbers in order: two to four letters and three to six digits, with or without a joint."""
    found = []
    for m in _PART_NUMBER.finditer(text):
        word, joint, digits = m.groups()
        low = word.lower()
        if joint == " " and (low in PROMOTION or len(digits) < 4 or len(word) < 3):
            continue
        if joint == " " and _SIZE.match(text, m.start(3)):
            continue
        if low in _UNIT or (digits.startswith("20") and len(digits) == 4 and joint == " " and text[m.end() :].lower().startswith(" edition")):
            continue
        if word.upper() + digits not in found:
            found.append(word.upper() + digits)
    return found


def sizes(text: str, guarded: bool) -> list[tuple[str, float]]:
    """(dimension, amount in the base unit) of the sizes in a text; in a body, only those that can be the product's."""
    out = []
    for m in _SIZE.finditer(text):
        if guarded:
            before = text[max(0, m.start() - 40) : m.start()]
            if _NOT_SIZE.search(before) or before.rstrip()[-1:] in ("<", ">", "=", "~", "$", "*", "+"):
                continue
        if m.group(3):
            dim, amount = "length", float(m.group(3)) * 25.4
        else:
            unit = re.sub(r"fl\.?\s*oz", "fl oz", m.group(2).lower())
            dim, factor = _UNIT[unit]
            amount = float(m.group(1).replace(",", ".")) * factor
        if amount > 0:
            out.append((dim, amount))
    return out


def pack(text: str) -> int | None:
    m = _PACK.search(text)
    return int(m.group(1) or m.group(2)) if m else None


def version(text: str) -> int | None:
    m = _VERSION.search(text)
    if not m:
        return None
    v = (m.group(1) or m.group(2)).lower()
    return int(v) if v.isdigit() else _ROMAN.get(v)


class Reader:
    """Takes listings apart with dictionaries that were learned from the whole table."""

    def __init__(self, vocabulary: dict[str, set[str]], brands: dict[str, str], parts: set[str], colors: dict[str, int]) -> None:
        self.vocabulary, self.brands, self.parts, self.colors = vocabulary, brands, parts, colors
        self.brand_words = max((len(b.split()) for b in brands), default=1)
        self.color_words = max((len(c.split()) for c in colors), default=1)
        names = sorted((re.escape(c) for c in colors), key=len, reverse=True)
        self.color_in = re.compile(r"(?<![^\W_])(" + "|".join(names) + r")(?![^\W_])", re.I) if names else re.compile(r"(?!)")
        self.color_cue = re.compile(r"\b(?:colou?r)\s*:?\s*(" + "|".join(names) + r")(?![^\W_])|(?:^|[•✓;,./|\n]\s*|listing is for )(" + "|".join(names) + r")(?: version)?\s*(?=[•✓;,./|\n]|$)", re.I) if names else re.compile(r"(?!)")
        self.entered_color = lru_cache(100_000)(self._entered_color)

    def _entered_color(self, value: str) -> int | None:
        text = plain(value).lower()
        text = re.sub(C.COLOR_LEAD, "", re.sub(C.COLOR_TAIL, "", re.sub(C.COLOR_LEAD, "", text))).strip(" .")
        half = [h.strip() for h in text.split("/")]
        text = half[0] if len(half) == 2 and half[0] == half[1] else text
        text = text.replace("-", " ")
        if text in self.colors:
            return self.colors[text]
        near = {c for n, c in self.colors.items() if len(n) >= 4 and abs(len(n) - len(text)) <= 1 and _one_edit(n, text)}
        return near.pop() if len(near) == 1 else None

    def read(self, locale, title, brand, color, bullets, description) -> tuple:
        head = plain(title)
        # the lines of a text are kept apart as list items
        body = " • ".join(plain(line) for t in (bullets, description) if t for line in t.split("\n"))
        low = head.lower()
        part, rest = None, head
        spare = low.find("(spare part)")
        if spare >= 0:
            part, rest = " ".join(low[:spare].split()[-2:]), head[:spare] + " " + head[spare + 12 :]
        split = _FOR.search(rest)
        if split:
            part, rest = " ".join(rest[: split.start()].lower().split()[-2:]), rest[: split.start()] + " | " + rest[split.end() :]
        elif part is None and "replacement" in low:
            part = low
        numbers = part_numbers(head) or part_numbers(body)
        whole_sizes = sizes(head, False)
        for pattern in (_PACK, _VERSION, _SIZE):
            rest = pattern.sub(" | ", rest)
        if numbers:
            rest = _PART_NUMBER.sub(lambda m: " | " if m.group(1).upper() + m.group(3) in numbers else m.group(0), rest)
        color_id = None
        found = [self.colors[m.group(1).lower()] for m in self.color_in.finditer(head)]
        named = self.entered_color(color) if color else None
        if found:
            color_id = found[0] if named is None or named not in found else named
        elif named is not None:
            color_id = named
        else:
            m = self.color_cue.search(body)
            if m:
                color_id = self.colors[(m.group(1) or m.group(2)).lower()]
        words = _WORDS.findall(self.color_in.sub(" ", rest).lower())
        own = tuple(_WORDS.findall(plain(brand).lower())) if brand else ()
        brand_key, kept, at = None, [], 0
        while at < len(words):
            if own and words[at] == own[0] and tuple(words[at : at + len(own)]) == own and len("".join(own)) > 3 and own[0] not in PROMOTION:
                brand_key, at = brand_key or " ".join(own), at + len(own)
                continue
            for n in range(min(self.brand_words, len(words) - at), 0, -1):
                hit = self.brands.get(" ".join(words[at : at + n]))
                if hit is not None:
                    brand_key, at = hit, at + n
                    break
            else:
                kept.append(words[at])
                at += 1
        vocabulary = self.vocabulary.get(locale or "", set())
        kept = [w for w in kept if w.isascii() and w.isalpha() and len(w) > 2 and w not in vocabulary and w not in PROMOTION and not (part is not None and (w in self.parts or w == "replacement"))]
        kept = list(dict.fromkeys(kept))
        if part is not None:
            part = " ".join(sorted({w for w in _WORDS.findall(part) if w in self.parts})) or "part"
        all_sizes = whole_sizes or sizes(body, True)
        return (
            kept,
            numbers,
            gtins(head + " " + body),
            brand_key,
            [{"dim": d, "amount": a} for d, a in all_sizes],
            pack(head) or pack(_BOXED.sub(" ", body)) or 1,
            version(head) or version(body) or 1,
            color_id,
            part,
        )


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


READ = T.StructType(
    [
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("numbers", T.ArrayType(T.StringType())),
        T.StructField("gtins", T.ArrayType(T.StringType())),
        T.StructField("brand_key", T.StringType()),
        T.StructField("sizes", T.ArrayType(T.StructType([T.StructField("dim", T.StringType()), T.StructField("amount", T.DoubleType())]))),
        T.StructField("pack", T.IntegerType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("color_id", T.LongType()),
        T.StructField("part", T.StringType()),
    ]
)


def learn(products: DataFrame, brands: DataFrame, colors: DataFrame) -> Reader:
    """Dictionaries of bounded size: as the share of a locale's vocabulary words over its part numbers is bounded
    below, there are at most 1 / VOCABULARY of them per word of a title; brands and colours are the fixed lists (the
    brand that a listing itself names needs no list); part names are words of the trade."""
    # counted per part number, not per title, so a range with very many listings has no more say than others
    title = F.lower(F.translate("title", C.FOLD_FROM, C.FOLD_TO))
    number = F.concat(F.regexp_extract(title, _NUMBER_SQL, 1), F.regexp_extract(title, _NUMBER_SQL, 2))
    words = products.filter("title IS NOT NULL").select(F.coalesce("locale", F.lit("")).alias("locale"), number.alias("number"), F.explode(F.array_distinct(F.split(title, r"[^\p{L}\p{N}]+"))).alias("word"))
    words = materialize(words.filter("number <> '' AND length(word) > 2").distinct(), "words")
    counts = words.groupBy("locale").agg(F.countDistinct("number").alias("numbers"))
    common = words.groupBy("locale", "word").agg(F.count(F.lit(1)).alias("n")).join(counts, "locale")
    common = common.filter((F.col("n") >= LEAST_NUMBERS) & (F.col("n") > VOCABULARY * F.col("numbers")))
    vocabulary: dict[str, set[str]] = {}
    for r in common.toLocalIterator():
        vocabulary.setdefault(r["locale"], set()).add(r["word"])
    # an accessory is called "<part> for <product>"; the one or two words before "for" are the part's name, if it
    # is sold for several products
    low = F.lower("title")
    named = [products.select(F.regexp_extract(low, rf"(\p{{L}}+)\s+{between}for\s+(\S+\s+\S+)", 1).alias("w"), F.regexp_extract(low, rf"(\p{{L}}+)\s+{between}for\s+(\S+\s+\S+)", 2).alias("of")) for between in ("", r"\p{L}+\s+")]
    wholes = named[0].unionByName(named[1]).filter("w <> ''").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    parts = {r["w"] for r in wholes.filter(F.col("n") >= LEAST_WHOLES).toLocalIterator()}
    parts -= PROMOTION | {"replacement", "spare"}
    spelled = {}
    for r in brands.select("brand_name").toLocalIterator():
        if r["brand_name"]:
            name = " ".join(_WORDS.findall(plain(r["brand_name"]).lower()))
            spelled[name] = name
    for name in [n for n in spelled if re.search(r"\b(?:unbranded|brand|generic|seller|various|unknown|none|marca|title|apply)\b", n)]:
        del spelled[name]
    shades: dict[str, int] = {}
    for r in colors.select("color_id", "color_name", "other_names").toLocalIterator():
        for n in [r["color_name"], *(r["other_names"] or [])]:
            if n:
                shades.setdefault(plain(n).lower().replace("-", " "), r["color_id"])
    return Reader(vocabulary, spelled, parts, shades)


def read_listings(products: DataFrame, reader: Reader) -> DataFrame:
    """One row of attributes for every row of ``products``."""
    shared = products.sparkSession.sparkContext.broadcast((reader.vocabulary, reader.brands, reader.parts, reader.colors))
    kind = products.schema["product_id"].dataType
    schema = T.StructType([T.StructField("product_id", kind), *READ.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        own, out = Reader(*shared.value), to_arrow_schema(schema)
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows = [own.read(*r) for r in zip(*cols[1:], strict=True)]
            read = list(zip(*rows, strict=True)) if rows else [[]] * len(READ)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=f.type) for c, f in zip(read, list(out)[1:], strict=True)]], schema=out)

    return spread(products.select("product_id", "locale", "title", "brand", "color", "bullets", "description")).mapInArrow(run, schema)


def _squashed(words: str) -> Column:
    return F.array_join(words, "")


def _agree(b1: str, b2: str, n1: str, n2: str) -> Column:
    """Neither brands nor part numbers contradict."""
    return F.expr(f"({b1} IS NULL OR {b2} IS NULL OR {b1} = {b2}) AND (size({n1}) = 0 OR size({n2}) = 0 OR arrays_overlap({n1}, {n2}))")


def _spellings(known: DataFrame) -> DataFrame:
    """``line``, ``meant``: rare names that are one edit from one other name, without a contradiction.

    A pigeonhole join on halves: of two names within one edit, one half of the longer stands unchanged in the other.
    """
    rare = known.filter(F.col("n") <= RARE).select(F.col("line").alias("val"), F.col("brand_key").alias("b"), F.col("n").alias("vn"), F.col("numbers").alias("vnum"))
    halves = "array(named_struct('i', 0, 'p', substring(line, 1, CAST(length(line) / 2 AS INT))), named_struct('i', 1, 'p', substring(line, 1 + CAST(length(line) / 2 AS INT))))"
    left = known.select("line", "n", "brand_key", "numbers", F.length("line").alias("len"), F.explode(F.expr(halves)).alias("s")).select("line", "n", "brand_key", "numbers", "len", "s.i", "s.p")
    shapes = "flatten(transform(sequence(length(val) - 1, length(val) + 1), len -> flatten(transform(array(0, 1), i -> transform(array(-1, 0, 1), d -> named_struct('len', len, 'i', i, 'at', CASE WHEN i = 0 THEN 1 ELSE 1 + CAST(len / 2 AS INT) END + d, 'width', CASE WHEN i = 0 THEN CAST(len / 2 AS INT) ELSE len - CAST(len / 2 AS INT) END))))))"
    right = rare.withColumn("s", F.explode(F.expr(shapes))).select("val", "b", "vn", "vnum", "s.len", "s.i", F.expr("CASE WHEN s.at >= 1 THEN substring(val, s.at, s.width) END").alias("p"), "s.width")
    right = right.filter("length(p) = width").drop("width").distinct()
    near = right.join(left, ["len", "i", "p"]).filter("val <> line AND n >= vn AND levenshtein(val, line) = 1").filter(_agree("b", "brand_key", "vnum", "numbers"))
    near = near.groupBy("val").agg(F.countDistinct("line").alias("c"), F.max_by("line", F.struct("n", "line")).alias("meant"), F.max("n").alias("n"), F.max("vn").alias("vn"))
    return near.filter("c = 1 AND (n > vn OR val > meant)").select(F.col("val").alias("line"), "meant")


def _contained(known: DataFrame) -> DataFrame:
    """``line``, ``meant``: names that hold another name as neighbouring words (an odd word stands beside it), without a
    contradiction. A single word must be the more frequent name."""
    windows = "flatten(transform(sequence(1, size(words) - 1), w -> transform(sequence(1, size(words) - w + 1), s -> named_struct('line', array_join(slice(words, s, w), ''), 'w', w))))"
    long = known.filter("size(words) > 1").select(F.col("line").alias("val"), F.col("brand_key").alias("b"), F.col("n").alias("vn"), F.col("numbers").alias("vnum"), F.explode(F.array_distinct(F.expr(windows))).alias("s"))
    long = long.select("val", "b", "vn", "vnum", "s.line", "s.w").filter(F.length("line") >= NAME_LETTERS)
    met = long.join(known.select("line", "n", "brand_key", "numbers"), "line").filter("w > 1 OR n > vn").filter(_agree("b", "brand_key", "vnum", "numbers"))
    return met.groupBy("val").agg(F.max_by("line", F.struct("n", "w", "line")).alias("meant")).select(F.col("val").alias("line"), "meant")


def _names(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings with the ``line`` of their name, distinct names with their listings ``n``, ``bag``, ``words``, brand and
    part numbers). Words of brands that other listings enter are dropped by a join, unless nothing would be left."""
    raw = read.filter("size(words) > 0").select("product_id", "words", _squashed("words").alias("raw"), "brand_key", "numbers")
    spelled = materialize(raw.groupBy("raw").agg(F.min("words").alias("words"), F.count(F.lit(1)).alias("_rows")), "raw")
    # a brand word is one that so many listings have in the brand which they name themselves
    brand = read.filter("brand_key IS NOT NULL").groupBy("brand_key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LEAST_WHOLES)
    brand = brand.select(F.explode(F.split("brand_key", " ")).alias("word")).filter("length(word) > 3").distinct()
    parts = spelled.filter("size(words) > 1").select("raw", F.posexplode("words").alias("at", "word")).join(brand, "word", "left_anti")
    kept = parts.groupBy("raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("kept")).filter(F.length(_squashed("kept")) >= NAME_LETTERS)
    lines = spelled.join(kept, "raw", "left").select("raw", "_rows", F.coalesce("kept", "words").alias("name")).withColumn("line", _squashed("name"))
    lines = materialize(lines.filter(F.length("line") >= NAME_LETTERS), "lines")
    named = materialize(heavy_light_join(raw.drop("words"), lines, ["raw"], "_rows").filter("line IS NOT NULL"), "named")
    # a name that a third of all rows have is one row from here on; the distinct part numbers of a name are few
    known = named.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.max("name").alias("words"), F.max("brand_key").alias("brand_key"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("numbers")))).alias("numbers")
    )
    return named, materialize(known.withColumn("bag", F.array_join(F.array_sort("words"), " ")), "names")


def _ranges(read: DataFrame) -> DataFrame:
    """``product_id``, ``range``: components of names and part numbers under their guards.

    A name is made of a title's naming words, however many there are and in whatever order.
    """
    named, known = _names(read)
    inner = materialize(_contained(known), "contained")
    meant = inner.unionByName(_spellings(known.join(inner, "line", "left_anti")))
    # the same words in another order, without a contradiction to the most frequent order
    first = known.groupBy("bag").agg(F.max_by(F.struct("line", "brand_key", "numbers"), F.struct("n", "line")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    orders = first.select("bag", F.col("f.line").alias("meant"), F.col("f.brand_key").alias("b"), F.col("f.numbers").alias("num")).join(known, "bag").filter("line <> meant").filter(_agree("b", "brand_key", "num", "numbers")).select("line", "meant")
    # a part number belongs to the name that it most often stands with (or one spelled nearly so)
    number = F.explode("numbers").alias("number")
    both = materialize(named.select("line", number).groupBy("number", "line").agg(F.count(F.lit(1)).alias("n")), "numbers")
    main = both.groupBy("number").agg(F.max_by("line", F.struct("n", "line")).alias("main"))
    of_number = both.join(main, "number").filter("line = main OR levenshtein(line, main) <= 2").select(F.concat(F.lit("l:"), "line").alias("u"), F.concat(F.lit("n:"), "number").alias("v"))
    # a listing without a name ties its part numbers together if they stand with one name only
    bare = read.join(named.select("product_id"), "product_id", "left_anti").filter("size(numbers) > 0").select("product_id", "numbers")
    several = bare.filter("size(numbers) > 1").select("product_id", F.col("numbers")[0].alias("first"), number).join(main, "number", "left")
    tied = several.groupBy("product_id", "first").agg(F.countDistinct("main").alias("c"), F.collect_set("number").alias("all")).filter("c <= 1")
    tied = tied.select(F.concat(F.lit("n:"), "first").alias("u"), F.explode("all").alias("v")).select("u", F.concat(F.lit("n:"), "v").alias("v")).distinct()
    of_name = meant.unionByName(orders).select(F.concat(F.lit("l:"), "line").alias("u"), F.concat(F.lit("l:"), "meant").alias("v"))
    found = materialize(components(of_number.unionByName(of_name).unionByName(tied), "u", "v"), "found")
    keyed = named.select("product_id", F.concat(F.lit("l:"), "line").alias("node")).unionByName(bare.select("product_id", F.concat(F.lit("n:"), F.col("numbers")[0]).alias("node")))
    sized = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("_rows")).join(found, "node", "left").withColumn("range", F.coalesce("component", "node")).drop("component")
    return heavy_light_join(keyed, materialize(sized, "ranges"), ["node"], "_rows").select("product_id", "range")


_OUNCE_MASS, _OUNCE_VOLUME = math.log(28.3495), math.log(29.5735)
#: The dimensions of sizes in the order in which a tie between them goes.
_DIMS = tuple(d for d in UNITS if d != "ounce")


def _in_scope(rows: DataFrame, scope: str) -> DataFrame:
    """``rows`` with ``cell``: equal for rows of one ``scope`` whose attributes agree.

    A scope (a range, an identifier, a component) is described by one group-by that combines on the map side: the
    listings per dimension of size, the distinct sizes (rounded logarithms, so a few thousand at most), the distinct
    colours. Sizes that differ by less than SIZE_STEP are one; ounces are of weight or volume as the others are. An
    unknown size or colour agrees if the scope knows at most one, else the row stays alone.
    """
    logs = F.transform("sizes", lambda x: F.struct(x["dim"].alias("d"), F.round(F.log(x["amount"]), 3).alias("a")))
    rows = rows.withColumn("_sizes", logs)
    has = lambda d: F.sum(F.exists("_sizes", lambda x: x["d"] == d).cast("int")).alias(f"_n_{d}")
    known = rows.groupBy(scope).agg(
        F.count(F.lit(1)).alias("_rows"), *[has(d) for d in UNITS], F.array_distinct(F.flatten(F.collect_set("_sizes"))).alias("_all"), F.array_sort(F.collect_set("color_id")).alias("_colors")
    )
    known = known.withColumn("_heavy", F.col("_n_mass") > F.col("_n_volume"))
    known = known.withColumn("_n_mass", F.col("_n_mass") + F.when(F.col("_heavy"), F.col("_n_ounce")).otherwise(0)).withColumn("_n_volume", F.col("_n_volume") + F.when(F.col("_heavy"), 0).otherwise(F.col("_n_ounce")))
    known = known.withColumn("_dim", F.array_max(F.array(*[F.struct(F.col(f"_n_{d}").alias("n"), F.lit(d).alias("d")) for d in _DIMS]))["d"])
    of_dim = "transform(filter({x}, s -> s.d = _dim OR (s.d = 'ounce' AND _dim = CASE WHEN _heavy THEN 'mass' ELSE 'volume' END)), s -> round(s.a + CASE WHEN s.d = 'ounce' THEN CASE WHEN _heavy THEN {m}D ELSE {v}D END ELSE 0D END, 3))"
    amounts = lambda x: F.expr(of_dim.format(x=x, m=_OUNCE_MASS, v=_OUNCE_VOLUME))
    known = known.withColumn("_seen", F.array_sort(F.array_distinct(amounts("_all"))))
    # the amounts with which another size begins
    known = known.withColumn("_starts", F.expr(f"filter(_seen, (x, i) -> i = 0 OR x - _seen[greatest(i - 1, 0)] > {math.log(SIZE_STEP)}D)"))
    known = materialize(known.select(scope, "_rows", "_dim", "_heavy", "_starts", "_colors"), "scopes")
    rows = heavy_light_join(rows, known, [scope], "_rows").withColumn("_own", F.get(amounts("_sizes"), F.lit(0)))
    size_no = F.expr("CASE WHEN _own IS NOT NULL THEN size(filter(_starts, x -> x <= _own)) END")
    alone = F.concat(F.lit("?"), F.col("product_id").cast("string"))
    size = F.when(size_no.isNotNull(), size_no.cast("string")).when(F.size("_starts") <= 1, F.lit("1")).otherwise(alone)
    color = F.when(F.col("color_id").isNotNull(), F.col("color_id").cast("string")).when(F.size("_colors") <= 1, F.coalesce(F.get("_colors", F.lit(0)).cast("string"), F.lit("-"))).otherwise(alone)
    cell = F.concat_ws("/", scope, size, color, F.col("pack").cast("string"), F.col("version").cast("string"), F.coalesce("part", F.lit("")))
    return rows.withColumn("cell", cell).drop("_sizes", "_dim", "_heavy", "_starts", "_colors", "_own")


def same_products(products: DataFrame, brands: DataFrame, colors: DataFrame) -> DataFrame:
    """``product_id``, ``group_id``: listings with equal ``group_id`` offer the same product.

    Every listing with a name, part number or identifier comes out once, alone in its group or not; one without any
    has no row. Null texts hold nothing; a missing pack count or version is 1. A listing whose size or colour is
    unknown joins no other of its range unless that knows just one; an identifier joins it nonetheless. Repeated
    product_ids are one listing. Columns besides those of the table do not matter.
    """
    reader = learn(products, brands, colors)
    read = materialize(read_listings(products, reader).dropDuplicates(["product_id"]), "read")
    attributes = read.select("product_id", "sizes", "pack", "version", "color_id", "part", "gtins")
    ranged = attributes.join(_ranges(read), "product_id", "left")
    # a listing of no range is a range of its own, for its identifiers
    ranged = ranged.filter("range IS NOT NULL OR size(gtins) > 0").withColumn("range", F.coalesce("range", F.concat(F.lit("?"), F.col("product_id").cast("string"))))
    rows = materialize(_in_scope(ranged, "range"), "cells")
    coded = rows.filter("size(gtins) > 0").withColumnRenamed("cell", "own").withColumn("code", F.explode("gtins"))
    shared = materialize(coded.groupBy("code").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").withColumn("_met", F.lit(True)), "codes")
    if shared.isEmpty():  # no identifier meets another listing, so no edge can arise
        return rows.select("product_id", F.sha2("cell", 256).alias("group_id"))
    by_code = _in_scope(heavy_light_join(coded, shared, ["code"], "_rows").filter("_met").drop("_met"), "code")
    edges = by_code.select(F.concat(F.lit("c:"), "own").alias("u"), F.concat(F.lit("g:"), "cell").alias("v"))
    merged = components(edges, "u", "v").filter("substr(node, 1, 2) = 'c:'").select(F.expr("substr(node, 3)").alias("cell"), "component")
    counted = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows")).join(merged, "cell", "left")
    rows = heavy_light_join(rows.drop("range"), materialize(counted, "merged"), ["cell"], "_rows")
    rows = materialize(rows, "joined")
    # what identifiers joined is looked at once more as a whole
    whole = _in_scope(rows.filter("component IS NOT NULL").drop("cell"), "component")
    out = rows.filter("component IS NULL").select("product_id", "cell").unionByName(whole.select("product_id", "cell"))
    return out.select("product_id", F.sha2("cell", 256).alias("group_id"))


def membership(groups: DataFrame) -> DataFrame:
    """``product_id``, ``group_id``, ``representative`` (the smallest id of the group) and ``listings`` of every listing."""
    sized = groups.groupBy("group_id").agg(F.min("product_id").alias("representative"), F.count(F.lit(1)).alias("listings"))
    sized = sized.withColumn("_rows", F.col("listings"))
    return heavy_light_join(groups, materialize(sized, "groups"), ["group_id"], "_rows")


def pairs(groups: DataFrame) -> DataFrame:
    """``product_id_a`` < ``product_id_b`` of every two listings of a group.

    The pairs are the result asked for, so their number is that of the result; a group of more than PAIR_SLICE
    listings is dealt over as many parts, each of which meets the whole group once, so no task has all its pairs.
    """
    sized = membership(groups).select("product_id", "group_id", F.ceil(F.col("listings") / PAIR_SLICE).cast("int").alias("_parts")).filter("listings > 1")
    part = F.pmod(F.xxhash64("product_id"), F.col("_parts")).cast("int")
    a = sized.select("group_id", F.col("product_id").alias("product_id_a"), part.alias("_part"))
    b = sized.select("group_id", F.col("product_id").alias("product_id_b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return a.join(b, ["group_id", "_part"]).filter("product_id_a < product_id_b").select("product_id_a", "product_id_b")
