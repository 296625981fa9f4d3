"""Vector expressions on array columns and a deterministic text encoder behind a small protocol."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import TOKEN, tokens_sql

#: Weight of a word's character trigrams beside the word itself.
TRIGRAM_WEIGHT = 0.25
DIMENSION = 384
#: Words whose features a task keeps at hand.
KNOWN_WORDS = 200_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; null if an operand is null or lengths differ in a null element."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


class Encoder(Protocol):
    """Anything that gives unit vectors for lists of terms; null or empty lists have none."""

    dimension: int

    def encode(self, terms: list[list[str] | None]) -> list[np.ndarray | None]: ...


class HashedFeatures:
    """Signed feature hashing of words and their character trigrams.

    A feature has MD5 digest d: its place is the first four hex digits modulo the dimension, its sign is
    negative if the fifth is 8 or more. A word counts 1, each trigram of ``<word>`` TRIGRAM_WEIGHT.
    """

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.dimension = dimension
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _word(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= KNOWN_WORDS:
                self._known.clear()
            found = self._known[word] = self._places(word)
        return found

    def _places(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        framed = f"<{word}>"
        features = [("w:" + word, 1.0), *(("t:" + framed[k : k + 3], TRIGRAM_WEIGHT) for k in range(len(framed) - 2))]
        digests = [(hashlib.md5(f.encode()).hexdigest(), w) for f, w in features]
        return np.array([int(d[:4], 16) % self.dimension for d, _ in digests]), np.array([-w if d[4] >= "8" else w for d, w in digests])

    def encode(self, terms: list[list[str] | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for words in terms:
            if words is None or not len(words):
                out.append(None)
                continue
            places, weights = zip(*map(self._word, words), strict=True)
            v = np.bincount(np.concatenate(places), np.concatenate(weights), self.dimension)
            size = float(np.sqrt((v * v).sum()))
            out.append((v / size).astype(np.float32) if size > 0 else None)
        return out


def encode(text: Column | str, encoder: Encoder | None = None) -> Column:
    """Unit vectors of a text column. Texts are cut into terms in the JVM; the encoder sees Arrow batches."""
    used = encoder or HashedFeatures()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(used.encode([None if t is None else list(t) for t in s]), index=s.index, dtype=object)

    terms = F.expr(tokens_sql(text)) if isinstance(text, str) else F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    return run(terms)


def encode_text(text: str | None, encoder: Encoder | None = None) -> list[float] | None:
    """The vector of one text in lower case, for a request."""
    (found,) = (encoder or HashedFeatures()).encode([re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", (text or "").lower())])
    return None if found is None else found.tolist()


def vectors_sql(key: str, text: str, source: str, name: str) -> str:
    """SQL for the oracle: ``name``(key, dim, x), the places of each unit vector that are not zero."""
    return f"""{name}_w AS (SELECT {key}, unnest({tokens_sql(text, False)}) AS w FROM {source}),
{name}_f AS (SELECT {key}, 'w:' || w AS f, 1.0::DOUBLE AS x FROM {name}_w
  UNION ALL SELECT {key}, 't:' || substr('<' || w || '>', i, 3), {TRIGRAM_WEIGHT}::DOUBLE FROM (SELECT {key}, w, unnest(range(1, length(w) + 1)) AS i FROM {name}_w)),
{name}_d AS (SELECT {key}, ('0x' || substr(d, 1, 4))::INTEGER % {DIMENSION} AS dim, sum(CASE WHEN substr(d, 5, 1) >= '8' THEN -x ELSE x END) AS x FROM (SELECT {key}, md5(f) AS d, x FROM {name}_f) GROUP BY ALL),
{name} AS (SELECT {key}, dim, (x / size)::FLOAT::DOUBLE AS x FROM {name}_d JOIN (SELECT {key}, sqrt(sum(x * x)) AS size FROM {name}_d GROUP BY {key}) USING ({key}) WHERE size > 0)"""
