"""Held-out test items in training text, found with suffix arrays of the training shards.

Every task turns its documents into shards of word numbers and sorts the suffixes of a shard (prefix doubling).
Every suffix of every test item is binary-searched in it: the range of its first START words gives all places
where it matches, and neighbouring places on a diagonal make the maximal verbatim matches, each with its place in
the item and in the document. The matches of a document and an item are chained over changed, added or left-out
words to running passages. A pair counts if its best passage, or its best two, hold enough of the item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.scratch import materialize, spread

#: Words of the shortest verbatim match.
START = 4
#: Words up to which suffixes are sorted; matches are followed beyond them from all their places.
DEPTH = 8
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Test items go out in blocks of at most this many words, and so many blocks share one pass over the corpus.
BLOCK_WORDS, BLOCKS = 500_000, 4
#: Words of the item or of the text between two matches of a running passage.
STEP = 8
#: A passage of fewer words is none.
PASSAGE = 8
#: An opening sentence that so many items share is a task instruction.
INSTRUCTION_ITEMS = 3

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")


@dataclass(frozen=True)
class Want:
    """What makes a pair a leak: its best one or two passages hold at least ``words`` words and at least ``share`` of
    the item's. An item of fewer words must be held whole."""

    words: int = 25
    share: float = 0.0

    def least(self, size: int) -> int:
        return max(min(self.words, size), int(np.ceil(self.share * size - 1e-9)), 1)


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


class TestItems:
    """A block of test items as word numbers with the suffixes to look up."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)], dtype=np.int64) for _, t in items]
        self.offset = np.append(0, np.cumsum([len(w) for w in self.words])).astype(np.int64)
        # suffixes with at least START words: item and place, and the different beginnings that they have
        counts = [max(0, len(w) - START + 1) for w in self.words]
        self.item = np.repeat(np.arange(len(items)), counts)
        self.place = np.concatenate([np.arange(n) for n in counts]) if counts else np.zeros(0, dtype=np.int64)
        flat = np.concatenate(self.words) if self.words else np.zeros(0, dtype=np.int64)
        begins = flat[(self.offset[self.item] + self.place)[:, None] + np.arange(START)] if len(self.item) else np.zeros((0, START), dtype=np.int64)
        self.begins, of = np.unique(begins, axis=0, return_inverse=True)
        # all suffixes of each beginning
        order = np.argsort(of.ravel(), kind="stable")
        self.item, self.place = self.item[order], self.place[order]
        self.first = np.append(0, np.cumsum(np.bincount(of.ravel(), minlength=len(self.begins)))).astype(np.int64)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions in the order of their next DEPTH words. Only positions that start with START known words."""
    n = len(ids)
    rank, step = ids.copy(), 1
    while step < DEPTH:
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - step] = rank[step:] + 1 if n > step else 0
        _, rank = np.unique(rank * (int(follow.max(initial=0)) + 1) + follow, return_inverse=True)
        step *= 2
        if rank.max(initial=0) == n - 1:
            break
    known = ids > 0
    ok = known.copy()
    for s in range(1, START):
        ok[: n - s] &= known[s:]
        ok[max(0, n - s) :] = False
    places = np.flatnonzero(ok)
    return places[np.argsort(rank[places], kind="stable")]


def _less(ids: np.ndarray, places: np.ndarray, wanted: np.ndarray, width: int, or_equal: bool) -> np.ndarray:
    """Is the text at each place smaller than the wanted words (or equal in all of them)?"""
    at = np.minimum(places[:, None] + np.arange(width), len(ids))
    have = np.append(ids, -2)[at]
    want = wanted[:, :width]
    differs = (have != want) & (want >= 0)
    first = np.argmax(differs, axis=1)
    rows = np.arange(len(places))
    result = have[rows, first] < want[rows, first]
    return np.where(differs.any(axis=1), result, or_equal)


def _bound(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray, width: int, upper: bool) -> np.ndarray:
    lo = np.zeros(len(wanted), dtype=np.int64)
    hi = np.full(len(wanted), len(order), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        less = _less(ids, order[mid], wanted[open_], width, upper)
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by the keys, the first one foremost; as one number where that has the room."""
    packed, room = np.zeros(len(keys[0]), dtype=np.int64), 1
    for k in keys:
        low = int(k.min())
        width = int(k.max()) - low + 1
        room *= width
        if room >= 2**62:
            return np.lexsort(keys[::-1])
        packed = packed * width + (k - low)
    return np.argsort(packed, kind="stable")


def matches(items: TestItems, texts: list[np.ndarray]) -> np.ndarray:
    """Rows (document, item, place in the item, place in the document, words) of all maximal verbatim matches of at
    least START words between the texts of a shard and the items, with all their places."""
    none = np.zeros((0, 5), dtype=np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    offset = np.append(0, np.cumsum(sizes))
    ids = np.zeros(int(offset[-1]), dtype=np.int64)
    for t, o in zip(texts, offset[:-1], strict=True):
        ids[o : o + len(t)] = t
    order = suffix_array(ids)
    if not len(order) or not len(items.begins):
        return none
    lo = _bound(ids, order, items.begins, START, False)
    hi = _bound(ids, order, items.begins, START, True)
    # every place of the range with every test suffix that begins so
    places, suffixes = hi - lo, np.diff(items.first)
    met = np.flatnonzero(places > 0)
    if not len(met):
        return none
    pairs = places[met] * suffixes[met]
    k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    width = np.repeat(suffixes[met], pairs)
    at = order[np.repeat(lo[met], pairs) + k // width]
    suffix = np.repeat(items.first[met], pairs) + k % width
    item, i = items.item[suffix], items.place[suffix]
    doc = np.searchsorted(offset, at, side="right") - 1
    j = at - offset[doc]
    by = _order(doc, item, j - i, j)
    doc, item, i, j = doc[by], item[by], i[by], j[by]
    # neighbours on a diagonal are one match
    starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (j[1:] != j[:-1] + 1) | (i[1:] != i[:-1] + 1)))
    return np.stack([doc[starts], item[starts], i[starts], j[starts], np.diff(np.append(starts, len(doc))) + START - 1], axis=1)


def passages(runs: list[tuple[int, int, int]], item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item start, item end, document start, document end, matched words) of running passages.

    ``runs`` are matches (place in the item, in the document, words). Two belong to one passage if at most STEP words
    of either side lie between them; of those, the words that agree count too.
    """
    done: list[tuple[int, int, int, int, int]] = []
    first, longest = 0, max(r[2] for r in runs)
    for i, j, n in sorted(runs, key=lambda r: (r[1], r[0])):
        best = (i, i + n, j, j + n, n)
        while first < len(done) and done[first][3] < j - STEP - longest:
            first += 1
        for i0, i1, j0, j1, m in done[first:]:
            gap_i, gap_j = i - i1, j - j1
            over = max(-gap_i, -gap_j, 0)
            if gap_i > STEP or gap_j > STEP or over >= n or i0 >= i or j0 >= j:
                continue
            between = 0
            if gap_i > 0 and gap_j > 0:
                same = item[i1:i] == doc[j1:j] if gap_i == gap_j else np.isin(item[i1:i], doc[j1:j])
                between = int(same.sum())
            if m + n - over + between > best[4]:
                best = (i0, i + n, j0, j + n, m + n - over + between)
        done.append(best)
    return done


def held(found: list[tuple[int, int, int, int, int]]) -> int:
    """Words of the best passage, or of the best two, in either order, that do not overlap in the text. A few words that
    both have of the item (a chance match at an end) count once."""
    found = sorted((p for p in found if p[4] >= PASSAGE), key=lambda p: p[2])
    if not found:
        return 0
    ends = sorted(found, key=lambda p: p[3])
    size = max(p[1] for p in found) + 1
    # best earlier passage of the text that ends before, or begins after, a position of the item
    until, since = np.zeros(size + 1, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
    best, k = 0, 0
    for i0, i1, j0, _j1, m in found:
        while k < len(ends) and ends[k][3] <= j0:
            np.maximum(until[ends[k][1] :], ends[k][4], out=until[ends[k][1] :])
            np.maximum(since[: ends[k][0] + 1], ends[k][4], out=since[: ends[k][0] + 1])
            k += 1
        shared = range(min(STEP, i1 - i0) + 1)
        best = max(best, m, *(m + int(until[i0 + t]) - t for t in shared), *(m + int(since[i1 - t]) - t for t in shared))
    return best


def leaking(items: TestItems, texts: list[np.ndarray], want: Want) -> list[tuple[int, int, int]]:
    """(document, item, words held) of the pairs that count. Pairs whose matches together are too short are left out
    before anything is chained: passages hold only places of the item that lie in matches, or in the STEP words before a match
    that begins within STEP words of another one's end."""
    rows = matches(items, texts)
    if not len(rows):
        return []
    starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    ends = np.append(starts[1:], len(rows))
    sizes = np.array([len(w) for w in items.words])
    least = np.array([want.least(int(n)) for n in sizes])
    group = np.repeat(np.arange(len(starts)), ends - starts)
    wide = int((rows[:, 3] + rows[:, 4]).max()) + STEP + 2
    stops = np.sort(group * wide + rows[:, 3] + rows[:, 4] + STEP)
    begin = group * wide + rows[:, 3] + STEP
    follows = np.searchsorted(stops, begin, side="right") > np.searchsorted(stops, begin - STEP, side="left")
    # the item's places that lie in matches or in such gaps, each once
    by = np.lexsort((rows[:, 2] - STEP * follows, group))
    width = int(sizes.max()) + STEP + 1
    lo = group[by] * width + np.maximum(rows[by, 2] - STEP * follows[by], 0)
    hi = group[by] * width + rows[by, 2] + rows[by, 4]
    until = np.append(-1, np.maximum.accumulate(hi)[:-1])
    most = np.add.reduceat(np.maximum(hi - np.maximum(lo, until), 0), starts)
    out = []
    for g in np.flatnonzero(most >= least[rows[starts, 1]]).tolist():
        d, n = rows[starts[g], :2].tolist()
        runs = [tuple(r) for r in rows[starts[g] : ends[g], 2:].tolist()]
        words = held(passages(runs, items.words[n], texts[d]))
        if words >= least[n]:
            out.append((d, n, words))
    return out


def longest_of(items: TestItems, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(item, place in the item, document, place in it, words): for every test suffix its longest matches in the shard,
    of at least 2 * START words, with all their places."""
    rows = matches(items, texts)
    rows = rows[rows[:, 4] >= 2 * START]
    if not len(rows):
        return []
    n = rows[:, 4] - 2 * START + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    doc, item, i, j, words = (np.repeat(rows[:, c], n) for c in range(5))
    i, j, words = i + step, j + step, words - step
    suffix = items.offset[item] + i
    best = np.zeros(int(items.offset[-1]) + 1, dtype=np.int64)
    np.maximum.at(best, suffix, words)
    keep = words == best[suffix]
    return list(zip(item[keep].tolist(), i[keep].tolist(), doc[keep].tolist(), j[keep].tolist(), words[keep].tolist(), strict=True))


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[TestItems]:
    """The items without their instructions, in blocks of bounded size. Only one block is in memory."""
    head = F.split(F.col(text), _SENTENCE.pattern, 2)
    cut = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"), head[0].alias("h"), F.when(F.size(head) == 2, head[1]).alias("r")).filter("t IS NOT NULL AND trim(t) <> ''")
    shared = cut.filter("r IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= INSTRUCTION_ITEMS).select("h", F.lit(True).alias("_is"))
    cut = cut.join(shared, "h", "left").select("i", F.when(F.col("_is"), F.col("r")).otherwise(F.col("t")).alias("t")).orderBy("i", "t")
    block, size = [], 0
    for row in cut.toLocalIterator():
        n = len(words_of(row["t"]))
        if block and size + n > BLOCK_WORDS:
            yield TestItems(block)
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n
    if block:
        yield TestItems(block)


def _scan(docs: DataFrame, doc_id: str, text: str, shared: list, kind: T.DataType, item_type: T.DataType, find) -> DataFrame:
    """Rows that ``find(items, texts)`` gives as (document, item, item_at, doc_at, amount), from one pass over ``docs``."""
    schema = T.StructType([T.StructField("_doc", kind), T.StructField("_item", item_type), T.StructField("item_at", T.IntegerType()), T.StructField("doc_at", T.IntegerType()), T.StructField("amount", T.IntegerType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)

        def flush(ids, texts):
            for block in shared:
                items = block.value
                numbers = [np.array([items.number.get(w, 0) for w in t], dtype=np.int64) for t in texts]
                rows = [(ids[d], items.ids[n], i, j, m) for d, n, i, j, m in find(items, numbers)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                if texts and size + len(words) > SHARD_WORDS:
                    yield from flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words) + 1
        if texts:
            yield from flush(ids, texts)

    return spread(docs.select(doc_id, text).filter(F.col(text).isNotNull())).mapInArrow(run, schema)


def _each_block(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, item_text: str, find) -> DataFrame | None:
    spark, done, shared = docs.sparkSession, None, []

    def add():
        part = _scan(docs, doc_id, text, list(shared), docs.schema[doc_id].dataType, items.schema[item_id].dataType, find)
        shared.clear()
        return part if done is None else done.unionByName(part)

    for block in item_blocks(items, item_id, item_text):
        shared.append(spark.sparkContext.broadcast(block))
        if len(shared) == BLOCKS:
            done = add()
    return add() if shared else done


def _empty(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, rest: str) -> DataFrame:
    return docs.limit(0).select(doc_id).crossJoin(items.limit(0).select(item_id)).selectExpr(f"`{doc_id}`", f"`{item_id}`", *rest.split(", "))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", want: Want = Want()) -> DataFrame:  # noqa: B008
    """``doc_id``, ``item_id``, ``words``: every document that holds enough of an item (see :class:`Want`) in one or two
    running passages, and how many of the item's words they hold.

    Case, punctuation, blanks and width do not matter; an opening sentence that several items share does not
    count. Null and empty texts hold and leak nothing. An item of fewer than START words after that leaks
    nothing. Repeated pages and repeated items count each. Whole texts are read; a very long document is a
    shard of its own. The corpus is read once for every BLOCKS * BLOCK_WORDS words of items. ``doc_id`` and
    ``item_id`` must have different names.
    """
    found = _each_block(docs, items, doc_id, item_id, text, item_text, lambda block, texts: [(d, n, None, None, m) for d, n, m in leaking(block, texts, want)])
    if found is None:
        return _empty(docs, items, doc_id, item_id, "CAST(NULL AS INT) AS words")
    return found.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), F.col("amount").alias("words"))


def longest_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """For every item suffix with a verbatim match of at least 2 * START words: the longest ones with all their places."""
    found = _each_block(docs, items, doc_id, item_id, text, item_text, lambda block, texts: [(d, n, i, j, m) for n, i, d, j, m in longest_of(block, texts)])
    if found is None:
        return _empty(docs, items, doc_id, item_id, "CAST(NULL AS INT) AS item_at, CAST(NULL AS INT) AS doc_at, CAST(NULL AS INT) AS words")
    found = materialize(found, "longest")
    # a row per suffix of the items
    best = found.groupBy("_item", "item_at").agg(F.max("amount").alias("amount"))
    out = found.join(best, ["_item", "item_at", "amount"])
    return out.select(F.col("_item").alias(item_id), "item_at", F.col("_doc").alias(doc_id), "doc_at", F.col("amount").alias("words"))


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that leak nothing by ``leaks``; those without an id stay."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
