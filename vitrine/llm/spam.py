"""Keyword piles, link lists and tag lists, found by how far their blocks compress.

A text is cut into pieces at line ends and sentence ends; runs of pieces of one kind (closed by sentence
punctuation or not) form blocks, long runs are cut into blocks of bounded length, and every block is
compressed on its own. Its ratio is divided by what sentence blocks of the same language and length reach in
the whole collection. A block is a pile if that quotient is extreme, or if it is low and a confirmation holds: hardly
any sentence or statement punctuation outside links. A block of sentences is one only if the quotient is extreme (keywords
stuffed into sentence frames), or if it is extreme with all repetitions and what is repeated is redundant
itself (a few stuffed sentences said again and again). A document is spam if piles make up its larger part.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.scratch import materialize, spread

#: A line of sentences with at least this many characters is a block of its own.
LINE_CHARS = 300
#: Longer runs are cut into blocks of at most this many characters.
BLOCK_CHARS = 2_000
#: A block that compresses to less than this part of what sentences of its length and language compress to is a pile.
EXTREME = 0.62
#: So is one below this part that has few statement marks.
REDUNDANT = 0.89
#: Sentences are a pile, marks or not, if they compress to less than this part even when repeated ones count once,
#: or with all repetitions if, counted once, they still are below REDUNDANT and tell words again as below.
STUFFED = 0.70
#: Stuffed sentences have more than this part of words that were in the same sentence before.
TOLD_AGAIN = 0.15
#: A pile has fewer statement marks per word than this.
MARKS = 0.08
#: A piece of more words than this is no sentence, whatever it ends with.
SENTENCE_WORDS = 80

#: A line whose pieces have fewer words than this on average is a list, whatever marks it has.
SENTENCE_LEAST = 5

_CUT = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])[」』)]*\s*")
_LINK = re.compile(r"[:»–-]?\s*\b(?:https?://|www\.)\S+", re.I)
_WORD = re.compile(r"[^\W_]+")
_SCRIPT = re.compile(r"[぀-ヿ㐀-鿿]+|[^぀-ヿ㐀-鿿]+")
_KANA = re.compile(r"[぀-ヿ㐀-鿿]")
_STATE = re.compile(r"[;:()；：（）](?=\s|$|[)\]\"'])|[(（]")
_ENUM = re.compile(r"^\s*\d{1,3}[.)]\s+")
_ENDS = frozenset(".!?。！？…")

BLOCK = "array<struct<sentence:boolean,chars:double,packed:int,ratio:double,marks:double,whole_packed:int,whole:double,again:double>>"


def _unlinked(text: str) -> str:
    """The text with each address as one word; the addresses of links differ at random."""
    return _LINK.sub(" link ", text) if "://" in text or "www." in text.lower() else text


def _words(text: str) -> float:
    """Words; Japanese characters count as half a word each, as it has no blanks."""
    if text.isascii():
        return len(_WORD.findall(text))
    kana = len(_KANA.findall(text))
    return len(_WORD.findall(_KANA.sub(" ", text))) + kana / 2


def _told_again(pieces: list[str]) -> float:
    """The part of the words of four letters or more, in Japanese pairs of characters, that were in the same sentence before."""
    all_, new = 0, 0
    for piece in pieces:
        found: list[str] = []
        for part in (p for w in _WORD.findall(_LINK.sub(" ", piece).lower()) for p in _SCRIPT.findall(w)):
            if _KANA.match(part):
                found += [part[i : i + 2] for i in range(len(part) - 1)]
            elif len(part) > 3 and not part.isdigit():
                found.append(part)
        all_, new = all_ + len(found), new + len(set(found))
    return (all_ - new) / max(all_, 1)


def _pieces(text: str):
    """(piece, closed sentence?, statement marks, paragraph) in order; short lines share a paragraph."""
    group = 0
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        if len(line) >= LINE_CHARS:
            group += 1
        listed = bool(_ENUM.match(line))
        parts = [p for p in _CUT.split(_ENUM.sub("", line)) if p and not p.isspace()]
        bare = [_unlinked(p) for p in parts]
        sizes = [_words(p) for p in bare]
        prose = sum(sizes) >= SENTENCE_LEAST * len(parts)
        for n, (part, size, plain) in enumerate(zip(parts, sizes, bare, strict=True)):
            closed = prose and size <= SENTENCE_WORDS and plain.rstrip().rstrip("\"')]")[-1:] in _ENDS
            yield part, closed, len(_STATE.findall(plain)) + (listed and n == 0), group
        group += len(line) >= LINE_CHARS


def _bounded(body: str) -> list[str]:
    parts = max(1, -(-len(body) // BLOCK_CHARS))
    size = max(1, -(-len(body) // parts))
    return [body[at : at + size] for at in range(0, len(body), size)]


def _ratio(block: str) -> float:
    raw = block.lower().encode("utf-8", "replace")
    return max(len(zlib.compress(raw, 9)) - 8, 1) / len(raw)


def blocks_of(text: str) -> list[tuple[bool, float, int, float, float, int, float, float]]:
    """(sentence block?, characters, characters compressed, their ratio, statement marks per word) of each block.

    Then the characters compressed and the ratio with repeated sentences left in, and the part of told-again words.
    """
    runs: list[tuple[bool, list[str], list[int]]] = []
    last = None
    for piece, closed, marks, group in _pieces(text):
        if (closed, closed and group) != last:
            runs.append((closed, [], []))
            last = (closed, closed and group)
        runs[-1][1].append(piece)
        runs[-1][2].append(marks)
    out = []
    for closed, pieces, marks in runs:
        chars = sum(map(len, pieces))
        body = _unlinked("\n".join(dict.fromkeys(pieces) if closed else pieces))
        per_word = sum(marks) / max(_words(body), 1.0)
        whole = _unlinked("\n".join(pieces)) if closed else body
        again = _bounded(whole) if len(whole) > len(body) else []
        all_ratio = sum(_ratio(b) * len(b) for b in again) / len(whole) if again else 0.0
        told = _told_again(list(dict.fromkeys(pieces))) if again else 0.0
        for block in _bounded(body):
            ratio = _ratio(block)
            kept = (len(again[0]), all_ratio) if again else (len(block), ratio)
            out.append((closed, chars * len(block) / len(body), len(block), ratio, per_word, *kept, told))
    return out


def blocks(text: Column | str) -> Column:
    @F.pandas_udf(BLOCK)
    def run(s: pd.Series) -> pd.Series:
        names = ("sentence", "chars", "packed", "ratio", "marks", "whole_packed", "whole", "again")
        return s.map(lambda t: [dict(zip(names, b, strict=True)) for b in blocks_of(t)] if isinstance(t, str) else [])

    return run(text)


def find_piles(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``doc_id``, ``pile_share`` (part of the characters in piles) and ``spam`` for every row of ``docs``.

    The expected ratio is the mean over the sentence blocks of the same language and length class, from all
    documents; a class without any takes the mean of its length class over all languages, then of everything.
    Null and empty texts have share 0 and are no spam. Null languages form a language. Repeated pages and ids
    count each. Other columns do not matter. Whole texts are read.
    """
    slim = spread(docs.select(doc_id, lang, text)).select(F.col(doc_id).alias("_id"), F.coalesce(lang, F.lit("")).alias("_lang"), F.monotonically_increasing_id().alias("_row"), blocks(text).alias("_blocks"))
    slim = materialize(slim, "blocks")
    flat = slim.select("_id", "_row", "_lang", F.explode("_blocks").alias("b")).select("_id", "_row", "_lang", "b.*")
    size = lambda c: F.floor(2 * F.log2(F.col(c).cast("double"))).cast("int")
    flat = flat.withColumn("_size", size("packed")).withColumn("_whole_size", size("whole_packed"))
    told = flat.filter("sentence")
    cells = told.groupBy("_lang", "_size").agg(F.avg("ratio").alias("_mean"), F.count(F.lit(1)).alias("_n")).filter("_n >= 20")
    sizes = told.groupBy("_size").agg(F.avg("ratio").alias("_mean_size"))
    overall = told.agg(F.avg("ratio").alias("_mean_all"))
    judged = flat.join(cells, ["_lang", "_size"], "left").join(sizes, "_size", "left").crossJoin(F.broadcast(overall))  # one row
    again = cells.select("_lang", F.col("_size").alias("_whole_size"), F.col("_mean").alias("_again"))
    again_size = sizes.select(F.col("_size").alias("_whole_size"), F.col("_mean_size").alias("_again_size"))
    judged = judged.join(again, ["_lang", "_whole_size"], "left").join(again_size, "_whole_size", "left")
    usual = F.coalesce("_mean", "_mean_size", "_mean_all", F.lit(0.7))
    usual_whole = F.coalesce("_again", "_again_size", "_mean_all", F.lit(0.7))
    piled = ~F.col("sentence") & ((F.col("ratio") < EXTREME * usual) | ((F.col("ratio") < REDUNDANT * usual) & (F.col("marks") < MARKS)))
    repeated = (F.col("whole") < STUFFED * usual_whole) & (F.col("ratio") < REDUNDANT * usual) & (F.col("again") > TOLD_AGAIN)
    pile = piled | (F.col("sentence") & ((F.col("ratio") < STUFFED * usual) | repeated))
    shares = judged.groupBy("_row").agg(F.sum("chars").alias("_chars"), F.sum(F.when(pile, F.col("chars")).otherwise(0)).alias("_piled"))
    out = slim.select("_id", "_row").join(shares, "_row", "left")
    share = F.coalesce(F.col("_piled") / F.col("_chars"), F.lit(0.0))
    return out.select(F.col("_id").alias(doc_id), F.round(share, 6).alias("pile_share"), (share > 0.5).alias("spam"))
