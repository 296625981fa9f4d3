"""Boosted regression trees over binned features, grown leaf by leaf over all rows of all tasks, applied anywhere.

Every task of one barrier stage keeps its rows (bins, scores, gradients) in files that it maps, so memory does not
grow with them. The tasks add up histograms along a tree of sockets; the first one picks the splits and tells them.
Gradients are rounded to a grid on which all sums are exact, so that the trees do not depend on the order of the rows
or on the number of tasks.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vitrine.operators.peers import Peers

#: Settings of both rankers: shrinkage, leaves of a tree, bins of a feature, rows of a leaf, L2 on leaf values, most
#: rounds, rounds without gain after which boosting stops.
RATE, LEAVES, BINS, LEAST_LEAF, LAMBDA_L2, ROUNDS, PATIENCE = 0.05, 31, 63, 20, 1.0, 300, 30
#: Features share one code as long as it has so few values: a histogram of the code holds those of all of them.
CELLS = 4096
#: Rows worked on at once.
PIECE = 1 << 16


@dataclass
class Trees:
    """Boosted trees. A tree is a list of (feature, cut, left, right, value, gain); leaves have feature -1."""

    edges: list[list[float]]
    base: float = 0.0
    trees: list[list[tuple[int, int, int, int, float, float]]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    @staticmethod
    def _arrays(tree: list) -> tuple[np.ndarray, ...]:
        cols = list(zip(*tree, strict=True))
        return tuple(np.array(c, dtype=np.int64) for c in cols[:4]) + (np.array(cols[4]),)

    def leaves(self, tree: list, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right, _ = self._arrays(tree)
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while True:
            f = feature[at]
            if (f < 0).all():
                return at
            at = np.where(f < 0, at, np.where(bins[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, bins = np.full(len(x), self.base), self.binned(x) if len(x) else None
        for tree in self.trees if len(x) else ():
            out += self._arrays(tree)[4][self.leaves(tree, bins)]
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """A column per feature and one for the base: what each split on the way adds; rows sum to the prediction."""
        out, bins = np.zeros((len(x), len(self.edges) + 1)), self.binned(x)
        out[:, -1] = self.base
        rows = np.arange(len(x))
        for tree in self.trees:
            feature, cut, left, right, value = self._arrays(tree)
            at = np.zeros(len(x), dtype=np.int64)
            out[:, -1] += value[0]
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                to = np.where(inner, np.where(bins[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]), at)
                np.add.at(out, (rows[inner], f[inner]), (value[to] - value[at])[inner])
                at = to
        return out

    def importance(self, kind: str = "gain") -> list[float]:
        """Per feature the summed gain of its splits, or their number (``split``)."""
        total = [0.0] * len(self.edges)
        for tree in self.trees:
            for f, _, _, _, _, gain in tree:
                if f >= 0:
                    total[f] += gain if kind == "gain" else 1.0
        return total

    def to_json(self) -> str:
        return json.dumps({"edges": self.edges, "base": self.base, "trees": self.trees, "history": self.history})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        note = json.loads(text)
        return cls(note["edges"], note["base"], [[tuple(n) for n in t] for t in note["trees"]], note["history"])


def _best_split(hist: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) from per-feature histograms of gradient, hessian and rows."""
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    score = lambda s: s[0] ** 2 / (s[1] + LAMBDA_L2)
    gain = score(left) + score(right) - score(total)
    gain[(left[2] < LEAST_LEAF) | (right[2] < LEAST_LEAF)] = -np.inf
    k = int(np.argmax(gain))
    f, b = divmod(k, hist.shape[2])
    return float(gain.flat[k]), f, b


class _Planner:
    """Grows a tree from summed histograms: the leaf with the largest gain is split until there are LEAVES.

    The histograms of several open leaves are asked for at once; splits are still made in the order of their gains, and
    what was asked for in vain stays out of the tree."""

    def __init__(self, hist: np.ndarray, rate: float) -> None:
        self.rate, self.hist, self.split, self.children, self.asked = rate, {0: hist}, {0: _best_split(hist)}, {}, []
        self.tree, self.span = [[-1, 0, 0, 0, self._value(hist), 0.0]], {0: 0}
        self.queue, self.leaves, self.spans = [(-self.split[0][0], 0)], 1, 1

    def _value(self, hist: np.ndarray) -> float:
        return float(self.rate * hist[0, 0].sum() / (hist[1, 0].sum() + LAMBDA_L2))

    def ask(self) -> list[tuple[int, int, int, int, int, bool]]:
        """(span, feature, bin, span of the left part, of the right part, is the left one to be counted?), or nothing at the end."""
        while self.queue and self.leaves < LEAVES and -self.queue[0][0] > 1e-12:
            node = self.queue[0][1]
            if self.span[node] not in self.children:
                ahead = heapq.nsmallest((LEAVES - self.leaves + 1) // 2, self.queue)
                self.asked = []
                for gain, k in ahead:
                    at = self.span[k]
                    if -gain > 1e-12 and at not in self.children:
                        _, f, b = self.split[at]
                        left = self.hist[at][2, f, : b + 1].sum()
                        self.children[at] = (self.spans, self.spans + 1)
                        self.asked.append((at, f, b, *self.children[at], bool(2 * left <= self.hist[at][2, f].sum())))
                        self.spans += 2
                return self.asked
            heapq.heappop(self.queue)
            at, ids = self.span[node], (len(self.tree), len(self.tree) + 1)
            gain, f, b = self.split[at]
            self.tree[node] = [f, b, *ids, self.tree[node][4], gain]
            for k, part in zip(ids, self.children[at], strict=True):
                self.tree.append([-1, 0, 0, 0, self._value(self.hist[part]), 0.0])
                self.span[k] = part
                heapq.heappush(self.queue, (-self.split[part][0], k))
            self.leaves += 1
        return []

    def take(self, hists: np.ndarray) -> None:
        for (at, _, _, left, right, first), near in zip(self.asked, hists, strict=True):
            far = self.hist[at] - near
            self.hist[left], self.hist[right] = (near, far) if first else (far, near)
            self.split[left], self.split[right] = _best_split(self.hist[left]), _best_split(self.hist[right])


class Rows(Protocol):
    """What an objective knows of the rows of a task: arrays by row, and where each query begins and ends."""

    label: np.ndarray
    gain: np.ndarray
    score: np.ndarray
    starts: np.ndarray


class Objective(Protocol):
    def base(self, labels: float, rows: int) -> float:
        """The first score, from the sum of all labels and their number."""

    def step(self, rows: Rows) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Gradients and curvatures of the rows at their scores, by slices."""

    def quality(self, rows: Rows) -> Iterator[np.ndarray]:
        """A value from 0 to 1 for each query."""


@dataclass
class _Part:
    label: np.ndarray
    gain: np.ndarray
    score: np.ndarray
    starts: np.ndarray


def _pieces(first: int, end: int) -> Iterator[slice]:
    for at in range(first, end, PIECE):
        yield slice(at, min(at + PIECE, end))


def _key(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; NaN is the largest."""
    bits = (x + 0.0).view(np.int64)
    return np.where(np.isnan(x), np.iinfo(np.int64).max, bits ^ ((bits >> 63) & np.iinfo(np.int64).max))


class _Files:
    """Arrays of a task in files of a folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def read(self, name: str, dtype: type) -> np.ndarray:
        return np.asarray(np.memmap(self.path(name), dtype, "r+")) if os.path.getsize(self.path(name)) else np.zeros(0, dtype)

    def new(self, name: str, dtype: type, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, dtype)
        return np.asarray(np.memmap(self.path(name), dtype, "w+", shape=(n,)))

    def drop(self, *names: str) -> None:
        for name in names:
            os.remove(self.path(name))


class _Booster:
    """One task's share of the rows: training queries first, then validation queries."""

    def __init__(self, batches: Iterable[pa.RecordBatch], m: int, files: _Files, peers: Peers, objective: Objective) -> None:
        self.files, self.peers, self.objective, self.m = files, peers, objective, m
        rows, starts, self.n, before = 0, [], 0, None
        names = ["label", "gain", *(f"raw{j}" for j in range(m))]
        out = [open(files.path(name), "wb", buffering=0) for name in names]  # noqa: SIM115
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = False
            for k in (0, 1):
                col = batch.column(k)
                new[1:] |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False)
            last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
            if before is not None and before == (batch.column(0)[0].as_py(), batch.column(1)[0].as_py()):
                new[0] = False
            before = last
            starts.append(np.flatnonzero(new) + rows)
            self.n += batch.num_rows - (pc.sum(batch.column(0)).as_py() or 0)
            for f, col in zip(out, batch.columns[2:], strict=True):
                np.ascontiguousarray(col.to_numpy(zero_copy_only=False), dtype=float).tofile(f)
            rows += batch.num_rows
        for f in out:
            f.close()
        self.rows = rows
        starts = np.append(np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64), rows)
        cut = int(np.searchsorted(starts, self.n))
        label, gain = files.read("label", float), files.read("gain", float)
        self.train = _Part(label[: self.n], gain[: self.n], files.new("score", float, self.n), starts[: cut + 1])
        self.held = _Part(label[self.n :], gain[self.n :], files.new("held", float, rows - self.n), starts[cut:] - self.n)
        self.grad, self.hess = files.new("grad", float, self.n), files.new("hess", float, self.n)
        self.order, self.spare = files.new("order", np.int64, self.n), files.new("spare", np.int64, self.n)

    def edges(self, total: int) -> list[list[float]]:
        """The lower quantiles of every feature over the rows of all tasks, exactly: each is narrowed down by halves, with
        counts of the values up to the middle."""
        rank = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (total - 1)).astype(np.int64) + 1
        values, upto = [], []
        ends = np.full((2, self.m), np.iinfo(np.int64).min)  # largest key, and complement of the smallest
        for j in range(self.m):
            key, count = np.unique(_key(np.asarray(self.files.read(f"raw{j}", float)[: self.n])), return_counts=True)
            key.tofile(self.files.path(f"key{j}"))
            np.append(0, np.cumsum(count)).astype(np.int64).tofile(self.files.path(f"upto{j}"))
            values.append(self.files.read(f"key{j}", np.int64))
            upto.append(self.files.read(f"upto{j}", np.int64))
            if len(key):
                ends[:, j] = key[-1], ~key[0]
        ends = self.peers.all(ends, np.maximum)
        low, high = np.repeat(~ends[1][:, None], len(rank), axis=1), np.repeat(ends[0][:, None], len(rank), axis=1)
        while (low < high).any():
            middle = (low & high) + ((low ^ high) >> 1)
            seen = self.peers.all(np.stack([u[np.searchsorted(v, x, side="right")] for v, u, x in zip(values, upto, middle, strict=True)]))
            low, high = np.where(seen >= rank, low, middle + 1), np.where(seen >= rank, middle, high)
        bits = low ^ ((low >> 63) & np.iinfo(np.int64).max)
        del values, upto
        self.files.drop(*(f"{kind}{j}" for j in range(self.m) for kind in ("key", "upto")))
        edges = [np.unique(x) for x in bits.view(float)]
        return [e[~np.isnan(e)].tolist() for e in edges]

    def bin(self, edges: list[list[float]]) -> None:
        """Codes of features that go together, in place of the values."""
        self.width = [len(e) + 1 for e in edges]
        packs: list[tuple[int, list[int]]] = []
        for j in sorted(range(self.m), key=lambda j: (-self.width[j], j)):
            k = next((k for k, (cells, _) in enumerate(packs) if cells * self.width[j] <= CELLS), len(packs))
            cells, of = packs.pop(k) if k < len(packs) else (1, [])
            packs.insert(k, (cells * self.width[j], [*of, j]))
        self.packs, self.place, self.codes = [of for _, of in packs], {}, []
        for k, of in enumerate(self.packs):
            codes, stride = self.files.new(f"codes{k}", np.uint16, self.rows), 1
            for j in reversed(of):
                self.place[j] = (k, stride)
                raw = self.files.read(f"raw{j}", float)
                for s in _pieces(0, self.rows):
                    codes[s] += (np.searchsorted(edges[j], raw[s], side="left") * stride).astype(np.uint16)
                stride *= self.width[j]
                self.files.drop(f"raw{j}")
            self.codes.append(codes)
        self.widest = max(self.width)

    def bins(self, j: int, rows: np.ndarray) -> np.ndarray:
        k, stride = self.place[j]
        return self.codes[k][rows] // stride % self.width[j]

    def histogram(self, first: int, end: int) -> np.ndarray:
        """Gradient, curvature and rows by feature and bin, of a span of ``order``."""
        out = np.zeros((3, self.m, self.widest))
        sums = [np.zeros((3, math.prod(self.width[j] for j in of))) for of in self.packs]
        for s in _pieces(first, end):
            rows = self.order[s]
            grad, hess = self.grad[rows], self.hess[rows]
            for codes, into in zip(self.codes, sums, strict=True):
                code = codes[rows].astype(np.intp)
                for i, weights in enumerate((grad, hess, None)):
                    into[i] += np.bincount(code, weights, into.shape[1])
        for of, into in zip(self.packs, sums, strict=True):
            self._apart(into, of, out)
        return out

    def _apart(self, sums: np.ndarray, of: list[int], out: np.ndarray) -> None:
        """The histogram of each feature from that of their common code, by halves of the features."""
        if len(of) == 1:
            out[:, of[0], : self.width[of[0]]] = sums
            return
        near, far = of[: len(of) // 2], of[len(of) // 2 :]
        both = sums.reshape(3, math.prod(self.width[j] for j in near), -1)
        self._apart(both.sum(axis=2), near, out)
        self._apart(both.sum(axis=1), far, out)

    def part(self, first: int, end: int, j: int, b: int) -> int:
        """Put the rows of a span with bins up to ``b`` before the others, in their order; the place where these begin."""
        at, others = first, 0
        for s in _pieces(first, end):
            rows = self.order[s]
            go = self.bins(j, rows) <= b
            near, far = rows[go], rows[~go]
            self.order[at : at + len(near)] = near
            self.spare[others : others + len(far)] = far
            at, others = at + len(near), others + len(far)
        for s in _pieces(0, others):
            self.order[at + s.start : at + s.stop] = self.spare[s]
        return at

    def grow(self, total: int, rate: float) -> list:
        """The next tree; the scores of all rows take it in."""
        top = np.zeros(2)
        for s, grad, hess in self.objective.step(self.train):
            self.grad[s], self.hess[s] = grad, hess
            if len(grad):
                top = np.maximum(top, [np.abs(grad).max(), np.abs(hess).max()])
        top = self.peers.all(top, np.maximum)
        # sums of so many whole numbers of this size are below 2^52, so they are exact
        scale = [2.0 ** (51 - math.ceil(math.log2(total * t))) if t > 0 else 1.0 for t in top]
        for s in _pieces(0, self.n):
            self.order[s] = np.arange(s.start, s.stop)
            self.grad[s], self.hess[s] = np.round(self.grad[s] * scale[0]) / scale[0], np.round(self.hess[s] * scale[1]) / scale[1]
        spans, planner = {0: (0, self.n)}, None
        whole = self.peers.sum(self.histogram(0, self.n))
        if whole is not None:
            planner = _Planner(whole, rate)
        while asked := self.peers.tell(planner and planner.ask()):
            near = []
            for at, f, b, left, right, first in asked:
                begin, end = spans[at]
                cut = self.part(begin, end, f, b)
                spans[left], spans[right] = (begin, cut), (cut, end)
                near.append(self.histogram(*spans[left if first else right]))
            near = self.peers.sum(np.stack(near))
            if planner:
                planner.take(near)
        tree, span = self.peers.tell(planner and ([tuple(n) for n in planner.tree], planner.span))
        for k, node in enumerate(tree):
            if node[0] < 0:
                for s in _pieces(*spans[span[k]]):
                    self.train.score[self.order[s]] += node[4]
        for s in _pieces(self.n, self.rows):
            todo = [(0, np.arange(s.start, s.stop))]
            while todo:
                k, rows = todo.pop()
                f, b, left, right, value, _ = tree[k]
                if f < 0:
                    self.held.score[rows - self.n] += value
                else:
                    go = self.bins(f, rows) <= b
                    todo += [(left, rows[go]), (right, rows[~go])]
        return tree

    def quality(self) -> float:
        """Mean over the validation queries of all tasks, in parts of 2^-36, so that their order does not matter."""
        total = np.zeros(2, dtype=np.int64)
        for values in self.objective.quality(self.held):
            total += [np.round(values * 2.0**36).astype(np.int64).sum(), len(values)]
        total = self.peers.all(total)
        return float(total[0] / 2.0**36 / total[1])

    def run(self, rounds: int, patience: int) -> Trees:
        total, held = self.peers.all(np.array([self.n, self.rows - self.n]))
        labels = float(self.peers.all(np.array([self.train.label.sum()]))[0])
        if not total:
            return Trees([[] for _ in range(self.m)], self.objective.base(0.0, 0))
        model = Trees(self.edges(int(total)), self.objective.base(labels, int(total)))
        self.bin(model.edges)
        self.train.score[:], self.held.score[:] = model.base, model.base
        best = (-np.inf, 0)
        for n in range(1, rounds + 1):
            tree = self.grow(int(total), RATE)
            if len(tree) == 1:
                break
            model.trees.append(tree)
            if not held:
                best = (0.0, n)
                continue
            model.history.append(self.quality())
            if model.history[-1] > best[0] + 1e-12:
                best = (model.history[-1], n)
            elif n - best[1] >= patience:
                break
        del model.trees[best[1] :]
        return model


def boost(batches: Iterable[pa.RecordBatch], m: int, objective: Objective, rounds: int = ROUNDS, patience: int = PATIENCE) -> Iterator[pa.RecordBatch]:
    """The work of one task of a barrier stage; the first gives the trees, as text.

    The batches hold "is it for validation?", the query, label, gain and ``m`` features, ordered by the first two (and
    within a query as the objective wants it); a query is in one task. A tree is grown on the gradients that the
    objective gives for the scores so far. After ``patience`` rounds without a better quality of the validation
    queries boosting stops; the trees up to the best round remain. Without validation rows all rounds count.
    """
    where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with Peers() as peers, tempfile.TemporaryDirectory(prefix="boost-", dir=where, ignore_cleanup_errors=True) as folder:
        model = _Booster(batches, m, _Files(folder), peers, objective).run(rounds, patience)
        if peers.rank == 0:
            yield pa.RecordBatch.from_arrays([pa.array([model.to_json()])], names=["model"])
