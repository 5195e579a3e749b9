"""Regression trees grown over binned rows that stay spread over the tasks.

Every feature is cut into at most BINS bins, one byte a value, and the rows are kept in blocks. A level of a tree
is one pass: each task sums target and rows per node, feature and bin, and the sums are added up. A node whose
rows fit one task (GROUP_ROWS) is finished there with its whole subtree: deep levels have more nodes than their
sums are worth. Such a task reads all blocks and keeps the rows of its nodes, so that no tree shuffles rows. If
all rows fit one task, it reads and holds them once for all its trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.sources.storage import stage

BINS = 32
CUT_ROWS = 10_000  # rows that the cut points are taken from
BLOCK_ROWS = 1 << 14
GROUP_ROWS = 1 << 22  # rows that one task may finish, some 100 bytes each
TOP_SUMS = 1 << 11  # nodes whose sums are added up at once, over all trees
TREES_AT_ONCE = 16
TREES_A_JOB = 32  # without passes; they bound what a job returns
TASKS_A_CORE = 4  # of those that grow whole trees; each reads all blocks
_SLICE = 128  # nodes whose bins are summed at once within a task
_SLICE_ROWS = 1 << 14  # and their rows, so that they stay in a processor's cache
_LONE_ROWS = 1 << 11  # a node of more rows is summed by itself
_BLOCK = "id long, n int, bins binary, label binary, total binary"


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays, the root first. A row goes to left + 1 if its bin of the feature is above the cut, else to
    left; a leaf is its own left, with a cut that no bin is above."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    gains: np.ndarray  # by feature: squared error taken away, summed over the nodes

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        n = bins.shape[1]
        at, row, flat = np.zeros(n, np.int64), np.arange(n), np.ascontiguousarray(bins).reshape(-1)
        nodes = self.left.astype(np.int64) << 24 | self.feature.astype(np.int64) << 8 | self.cut
        for _ in range(self.depth):
            node = nodes.take(at)
            place = (node >> 8) & 0xFFFF
            place *= n
            place += row
            at = (node >> 24) + (flat.take(place) > (node & 0xFF))
        return at

    def forecast(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(bins)]


@dataclass(frozen=True)
class Block:
    """Some rows: bins (features x rows), label and the running forecast."""

    id: int
    bins: np.ndarray
    label: np.ndarray
    total: np.ndarray


def features_per_node(strategy: str, n: int) -> int:
    """The number of features a node may be split by, as MLlib's featureSubsetStrategy names it."""
    named = {"all": n, "auto": math.ceil(n / 3), "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), n) if strategy.isdigit() else math.ceil(float(strategy) * n)


def cut_points(values: np.ndarray) -> np.ndarray:
    """Thresholds between distinct values: all, or those that part the rows into about equal bins."""
    found, times = np.unique(values[np.isfinite(values)], return_counts=True)
    between = found[:-1] + (found[1:] - found[:-1]) / 2
    if len(between) >= BINS:
        shares = np.cumsum(times)[:-1]
        at = np.searchsorted(shares, times.sum() * np.arange(1, BINS) / BINS)
        between = between[np.unique(np.minimum(at, len(between) - 1))]
    return between


def all_cut_points(rows: DataFrame, features: list[str], n: int, seed: int) -> list[np.ndarray]:
    """Cut points of each feature from about CUT_ROWS drawn rows, the only rows the driver gets."""
    drawn = rows.select(*[F.col(f).cast("double") for f in features])
    if n > CUT_ROWS:
        drawn = drawn.sample(CUT_ROWS / n, seed)
    table = drawn.toPandas().to_numpy(np.float64)
    return [cut_points(column) for column in table.T]


def binned(columns: Iterable[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value, one byte; a missing value is above all cuts."""
    return np.stack([np.searchsorted(c, x).astype(np.uint8) for x, c in zip(columns, cuts, strict=True)])


def _to_blocks(cuts: list[np.ndarray], start: float) -> Callable:
    def pack(batches: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        columns = [c.to_numpy() for c in table.columns]
        for i in range(0, table.num_rows, BLOCK_ROWS):
            part = [np.asarray(c[i : i + BLOCK_ROWS], np.float64) for c in columns]
            n = len(part[-1])
            held = binned(part[:-1], cuts).tobytes(), part[-1].tobytes(), np.full(n, start).tobytes()
            names = ["id", "n", "bins", "label", "total"]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            made = ((TaskContext.get().partitionId() << 32) + number, n, *held)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], names)
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, number = [], 0, 0
        for batch in batches:
            waiting, rows = [*waiting, batch], rows + batch.num_rows
            if rows >= BLOCK_ROWS:
                for out in pack(waiting, number):
                    yield out
                    number += 1
                waiting, rows = [], 0
        if rows:
            yield from pack(waiting, number)

    return run


def _unpacked(row) -> Block:
    label, total = np.frombuffer(row.label), np.frombuffer(row.total)
    return Block(row.id, np.frombuffer(row.bins, np.uint8).reshape(-1, row.n), label, total)


def _packed(b: Block) -> tuple:
    return b.id, len(b.label), b.bins.tobytes(), b.label.tobytes(), b.total.tobytes()


def to_blocks(rows: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], start: float = 0.0) -> RDD:
    """The rows, stored as blocks with `start` as their running forecast."""
    numbers = rows.select(*[F.col(c).cast("double") for c in (*features, label)])
    spread = numbers.mapInArrow(_to_blocks(cuts, start), _BLOCK).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return stage(spread, "blocks").rdd.map(_unpacked)


def stored(blocks: RDD, spark) -> RDD:
    """The blocks written and read back, so that their lineage does not grow."""
    return stage(spark.createDataFrame(blocks.map(_packed), _BLOCK), "blocks").rdd.map(_unpacked)


def draws(seed: int, tree: int, block: Block, share: float, again: bool) -> np.ndarray:
    """How often each row of a block takes part in a tree: drawn again and again, or kept with a chance of `share`."""
    draw = np.random.default_rng([seed, tree, block.id])
    n = len(block.label)
    if again:
        return draw.poisson(share, n).astype(np.uint8)
    return np.ones(n, np.uint8) if share >= 1 else (draw.random(n) < share).astype(np.uint8)


def best_splits(counts: np.ndarray, sums: np.ndarray, least: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For bins x features x nodes: the feature and bin that take most squared error away, how much (0: no
    split), and the rows on the left. Both sides keep `least` rows. The arrays given are overwritten."""
    for i in range(1, len(counts)):
        counts[i] += counts[i - 1]
        sums[i] += sums[i - 1]
    n, total = counts[-1, 0], sums[-1, 0]
    below, part = counts[:-1], sums[:-1]
    above = n - below
    fits = np.minimum(below, above) >= least
    if allowed is not None:
        fits &= allowed
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = total * total / n
        gain = part * part
        gain /= below
        rest = total - part
        rest *= rest
        rest /= above
        gain += rest
    np.copyto(gain, -np.inf, where=~fits)
    most, nodes = gain.max(0), np.arange(gain.shape[2])
    feature = most.argmax(0)
    won = most[feature, nodes] - whole
    won = np.where(won > 1e-11 * (1.0 + np.abs(whole)), won, 0.0)
    cut = gain[:, feature, nodes].argmax(0)
    return feature, cut, won, below[cut, feature, nodes]


class Growing:
    """A tree in the making."""

    def __init__(self, features: int, value: float = 0.0):
        self.feature, self.cut, self.left, self.value = [0], [255], [0], [value]
        self.depth, self.gains = 0, np.zeros(features)

    def split(self, node: int, feature: int, cut: int, gain: float) -> int:
        """Give a leaf two children; the index of the left one."""
        first = len(self.left)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        self.feature += [0, 0]
        self.cut += [255, 255]
        self.left += [first, first + 1]
        self.value += [0.0, 0.0]
        self.gains[feature] += gain
        return first

    def graft(self, node: int, tree: Tree, level: int) -> None:
        """Put a tree in the place of a leaf at `level`."""
        shift = len(self.left) - 1
        for to, source in ((self.feature, tree.feature), (self.cut, tree.cut), (self.value, tree.value)):
            to[node] = source[0]
            to.extend(source[1:])
        if tree.left[0]:
            self.left[node] = int(tree.left[0]) + shift
        self.left.extend((tree.left[1:] + shift).tolist())
        self.depth = max(self.depth, level + tree.depth)
        self.gains = self.gains + tree.gains

    def done(self, shift: float = 0.0) -> Tree:
        arrays = np.array(self.feature, np.uint16), np.array(self.cut, np.uint8), np.array(self.left, np.int32)
        return Tree(*arrays, np.array(self.value, np.float64) + shift, self.depth, self.gains)


def _subset(seed: list[int], nodes: int, features: int, k: int) -> np.ndarray:
    """k features for each node."""
    return np.argpartition(np.random.default_rng(seed).random((nodes, features)), k - 1, axis=1)[:, :k]


def _slices(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Nodes to be summed at once, from and to: one of many rows, or some that follow each other."""
    nodes, lone = len(starts) - 1, np.flatnonzero(np.diff(starts) > _LONE_ROWS)
    a = 0
    while a < nodes:
        i = np.searchsorted(lone, a)
        stop = int(lone[i]) if i < len(lone) else nodes
        b = a + 1 if stop == a else min(stop, a + _SLICE, int(np.searchsorted(starts, starts[a] + _SLICE_ROWS, "right")) - 1)
        yield a, b
        a = b


def _slice_sums(held: np.ndarray, weight: np.ndarray, aimed: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and target by bin, chosen feature and node; the rows lie side by side, sorted by node."""
    nodes, k = chosen.shape
    counts, sums = np.zeros((BINS, k, nodes)), np.zeros((BINS, k, nodes))
    first, last = int(starts[0]), int(starts[-1])
    if nodes == 1:
        for p in range(first, last, _SLICE_ROWS):
            r = slice(p, min(p + _SLICE_ROWS, last))
            for j, f in enumerate(chosen[0]):
                key = held[r, f].astype(np.intp)
                counts[:, j, 0] += np.bincount(key, weight[r], BINS)
                sums[:, j, 0] += np.bincount(key, aimed[r], BINS)
        return counts, sums
    flat, w, t = held.reshape(-1), weight[first:last], aimed[first:last]
    who = np.repeat(np.arange(nodes), np.diff(starts))
    row = np.arange(first, last) * held.shape[1]
    for j in range(k):
        key = chosen[:, j].take(who)
        key += row
        np.multiply(flat.take(key), nodes, out=key, dtype=np.int64)
        key += who
        counts[:, j] = np.bincount(key, w, BINS * nodes).reshape(BINS, nodes)
        sums[:, j] = np.bincount(key, t, BINS * nodes).reshape(BINS, nodes)
    return counts, sums


def finish(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, k: int, least: int, seed: list[int]) -> Tree:
    """The whole subtree over the given rows, level by level. The rows are moved so that those of a node lie side
    by side, and some nodes are summed at a time."""
    features = len(bins)
    held = np.ascontiguousarray(bins.T)
    starts = np.array([0, len(held)])  # bounds of each open node's rows
    weight = weight.astype(np.float64)
    aimed = weight * target
    feature, cut, left = [np.zeros(1, np.uint16)], [np.full(1, 255, np.uint8)], [np.zeros(1, np.int32)]
    value, gains, size = [np.array([aimed.sum() / max(weight.sum(), 1.0)])], np.zeros(features), 1
    open_at = np.array([0])  # where the open nodes are within the last level
    for level in range(depth):
        nodes = len(open_at)
        if nodes == 0:
            break
        chosen = _subset([*seed, level], nodes, features, k)
        best_f, best_c, best_g = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes)
        side = np.empty(len(held), bool)
        for a, b in _slices(starts):
            r = slice(starts[a], starts[b])
            slot, best_c[a:b], best_g[a:b], _ = best_splits(*_slice_sums(held, weight, aimed, starts[a : b + 1], chosen[a:b]), least)
            best_f[a:b] = chosen[np.arange(a, b), slot]
            if b == a + 1:
                side[r] = held[r, best_f[a]] > best_c[a]
            else:
                who = np.repeat(np.arange(a, b), np.diff(starts[a : b + 1]))
                side[r] = held.reshape(-1).take(best_f.take(who) + np.arange(r.start, r.stop) * features) > best_c.take(who)
        split = best_g > 0
        np.add.at(gains, best_f[split], best_g[split])
        number = np.cumsum(split) - 1
        children = 2 * int(split.sum())
        if children == 0:
            break
        # the last level's open nodes become splits, and their children a level of their own
        feature[-1][open_at[split]], cut[-1][open_at[split]] = best_f[split], best_c[split]
        left[-1][open_at[split]] = size + 2 * number[split]
        # rows of nodes that are not split go to two numbers beyond
        child = np.repeat(np.where(split, 2 * number, children), np.diff(starts)) + side
        n, total = (np.bincount(child, x, children + 2)[:children] for x in (weight, aimed))
        feature.append(np.zeros(children, np.uint16))
        cut.append(np.full(children, 255, np.uint8))
        left.append(np.arange(size, size + children, dtype=np.int32))
        value.append(total / n)
        size += children
        # a child of fewer than twice the least rows stays a leaf
        larger = n >= 2 * least
        open_at = np.flatnonzero(larger)
        if level + 1 < depth:
            goes = np.append(np.where(larger, np.cumsum(larger) - 1, len(open_at)), [len(open_at)] * 2)
            place = goes.astype(np.uint16 if len(open_at) < 1 << 16 else np.int64).take(child)
            starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(open_at) + 1)[:-1])])
            order = np.argsort(place, kind="stable")[: starts[-1]]
            held, weight, aimed = held.take(order, 0), weight.take(order), aimed.take(order)
    return Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(value), len(feature) - 1, gains)


@dataclass(frozen=True)
class Growth:
    """How trees are grown: on what share of the rows, drawn again or not, and by how many features a node."""

    depth: int
    least: int
    per_node: int
    seed: int
    share: float
    again: bool
    features: int
    group_rows: int = GROUP_ROWS

    def sums(self, blocks: RDD, trees: list[tuple[int, Tree]], small: list[np.ndarray]) -> np.ndarray:
        """Rows and target, by the nodes marked in `small` (tree after tree), feature and bin: one pass."""
        nodes = [int(s.sum()) for s in small]
        first = np.cumsum([0, *nodes])

        def partial(part: Iterable[Block]) -> Iterator[np.ndarray]:
            out, seen = np.zeros((2, int(first[-1]), self.features, BINS)), False
            for block in part:
                seen = True
                rest = block.label - block.total
                for i, (number, tree) in enumerate(trees):
                    place = np.full(len(tree.left), -1)
                    place[np.flatnonzero(small[i])] = np.arange(nodes[i])
                    weight = draws(self.seed, number, block, self.share, self.again)
                    at = place[tree.leaf_of(block.bins)]
                    rows = np.flatnonzero((weight > 0) & (at >= 0))
                    at, w, t = at[rows] * BINS, None, rest[rows]
                    if self.again:
                        w = weight[rows].astype(np.float64)
                        t = w * t
                    to, full = out[:, first[i] : first[i + 1]], nodes[i] * BINS
                    for f in range(self.features):
                        key = at + block.bins[f][rows]
                        to[0, :, f] += np.bincount(key, w, full).reshape(-1, BINS)
                        to[1, :, f] += np.bincount(key, t, full).reshape(-1, BINS)
            if seen:
                yield out

        return blocks.mapPartitions(partial).treeReduce(np.add, depth=2 if blocks.getNumPartitions() > 32 else 1)

    def _level(self, blocks: RDD, grown: dict[int, Growing], frontier: dict[int, list], level: int) -> dict[int, list]:
        """Split the frontier nodes of the trees, given as [(node, sums)], and give the next frontier. Of two
        children the smaller one is summed, and the other is the rest of their parent."""
        pairs: list[tuple] = []
        for number, nodes in frontier.items():
            tree, found = grown[number], np.stack([s for _, s in nodes], 1)
            allowed = np.zeros((len(nodes), self.features), bool)
            np.put_along_axis(allowed, _subset([self.seed, number, level], len(nodes), self.features, self.per_node), True, 1)
            by_bin = (np.ascontiguousarray(x.transpose(2, 1, 0)) for x in found)
            best = best_splits(*by_bin, self.least, allowed.T)
            for (node, sums), f, c, gain, below in zip(nodes, *best, strict=True):
                if gain > 0:
                    first = tree.split(node, int(f), int(c), float(gain))
                    tree.depth = level + 1
                    for child, s in ((first, sums[:, f, : c + 1]), (first + 1, sums[:, f, c + 1 :])):
                        n, total = s.sum(1)
                        tree.value[child] = total / n
                    n = sums[0, f].sum()
                    pairs.append((number, first, below, n - below, sums))
        if level + 1 == self.depth:
            return {}
        return self._children(blocks, grown, [p for p in pairs if max(p[2], p[3]) >= 2 * self.least])

    def _children(self, blocks: RDD, grown: dict[int, Growing], pairs: list[tuple]) -> dict[int, list]:
        if not pairs:
            return {}
        by_tree: dict[int, list] = {}
        for number, first, below, above, sums in pairs:
            by_tree.setdefault(number, []).append((first + int(above < below), first + int(above >= below), below, above, sums))
        trees, small = [], []
        for number, found in by_tree.items():
            mark = np.zeros(len(grown[number].left), bool)
            mark[[p[0] for p in found]] = True
            trees.append((number, grown[number].done()))
            small.append(mark)
        summed, out, i = self.sums(blocks, trees, small), {}, 0
        for number, found in by_tree.items():
            nodes = []
            for less, more, below, above, sums in sorted(found, key=lambda p: p[0]):
                one, i = summed[:, i], i + 1
                nodes += [(node, s) for node, s, n in ((less, one, min(below, above)), (more, sums - one, max(below, above))) if n >= 2 * self.least]
            out[number] = sorted(nodes, key=lambda x: x[0])
        return out

    def _roots(self, blocks: RDD, numbers: list[int]) -> tuple[dict[int, Growing], dict[int, list]]:
        grown = {i: Growing(self.features) for i in numbers}
        summed = self.sums(blocks, [(i, grown[i].done()) for i in numbers], [np.ones(1, bool)] * len(numbers))
        for at, i in enumerate(numbers):
            n, total = summed[:, at, 0].sum(1)
            grown[i].value[0] = total / max(n, 1.0)
        return grown, {i: [(0, summed[:, at])] for at, i in enumerate(numbers)}

    def by_levels(self, blocks: RDD, number: int) -> Tree:
        """One tree, a pass for every level: for few leaves and many rows."""
        if self.depth == 0:
            return Growing(self.features).done()
        grown, frontier = self._roots(blocks, [number])
        for level in range(self.depth):
            if not frontier:
                break
            frontier = self._level(blocks, grown, frontier, level)
        return grown[number].done()

    def whole(self, blocks: RDD, numbers: list[int], shift: float) -> RDD:
        """(number, tree) of trees whose rows fit a task. A task holds all rows once, however many trees it grows, and
        draws the rows of one tree after the other."""
        tasks = min(len(numbers), TASKS_A_CORE * blocks.context.defaultParallelism)

        def grow(task: int, part: Iterable[Block]) -> Iterator[tuple[int, Tree]]:
            held = [Block(b.id, np.ascontiguousarray(b.bins.T), b.label - b.total, b.total[:0]) for b in part]
            held.sort(key=lambda b: b.id)
            for number in numbers[task::tasks]:
                drawn = []
                for block in held:
                    weight = draws(self.seed, number, block, self.share, self.again)
                    rows = np.flatnonzero(weight > 0)
                    drawn.append((block.bins.take(rows, 0), block.label[rows], weight[rows]))
                bins, rest, weight = (np.concatenate([d[i] for d in drawn]) for i in range(3))
                del drawn
                tree = finish(bins.T, rest, weight, self.depth, self.per_node, self.least, [self.seed, number, 0])
                yield number, replace(tree, value=tree.value + shift)

        return blocks.context.union([blocks.coalesce(1)] * tasks).mapPartitionsWithIndex(grow)

    def by_groups(self, blocks: RDD, rows: int, numbers: list[int], shift: float) -> list[Tree]:
        """Many trees: passes for the nodes with more rows than a task may hold, then the rest, node by node."""
        at_once = max(1, min(TREES_AT_ONCE, int(TOP_SUMS * self.group_rows / max(2 * rows, 1)))) if rows > self.group_rows else TREES_A_JOB
        out = []
        for i in range(0, len(numbers), at_once):
            out += self._batch(blocks, rows, numbers[i : i + at_once], shift)
        return out

    def _batch(self, blocks: RDD, rows: int, numbers: list[int], shift: float) -> list[Tree]:
        # (tree, node, level, rows) of the nodes to finish
        ready = [(i, 0, 0, rows) for i in numbers]
        grown = {i: Growing(self.features) for i in numbers}
        if rows > self.group_rows and self.depth > 0:
            ready = []
            grown, frontier = self._roots(blocks, numbers)
            for level in range(self.depth):
                large: dict[int, list] = {}
                for number, nodes in frontier.items():
                    for node, sums in nodes:
                        n = sums[0, 0].sum()
                        if n > self.group_rows:
                            large.setdefault(number, []).append((node, sums))
                        else:
                            ready.append((number, node, level, n))
                frontier = self._level(blocks, grown, large, level) if large else {}
                if not frontier:
                    break
        whole: dict[int, Tree] = {}
        if ready:
            tops = {i: grown[i].done() for i in numbers}
            for (number, node, level), tree in self._finished(blocks, tops, ready):
                if node == 0:
                    whole[number] = replace(tree, value=tree.value + shift)
                else:
                    grown[number].graft(node, tree, level)
        return [whole.get(i) or grown[i].done(shift) for i in numbers]

    def _tasks(self, ready: list[tuple[int, int, int, float]], least: int) -> list[dict[int, dict[int, int]]]:
        """The nodes to finish dealt to tasks, as level by tree and node: as many as a task may hold, and about
        `least` tasks if there are as many nodes."""
        most = min(self.group_rows, sum(rows for *_, rows in ready) / least)
        out: list[dict[int, dict[int, int]]] = []
        held = math.inf
        for number, node, level, rows in ready:
            if held + rows > most:
                out.append({})
                held = 0.0
            out[-1].setdefault(number, {})[node] = level
            held += rows
        return out

    def _finished(self, blocks: RDD, tops: dict[int, Tree], ready: list[tuple[int, int, int, float]]) -> list[tuple[tuple[int, int, int], Tree]]:
        """A subtree for each of the nodes. Every task reads all blocks and holds the rows of its nodes only."""
        tasks = self._tasks(sorted(ready), 2 * blocks.context.defaultParallelism)

        def grow(task: int, part: Iterable[Block]) -> Iterator[tuple[tuple[int, int, int], Tree]]:
            kept = {(number, node): [] for number, nodes in tasks[task].items() for node in nodes}
            for block in part:
                lying, rest = np.ascontiguousarray(block.bins.T), block.label - block.total
                for number, nodes in tasks[task].items():
                    weight = draws(self.seed, number, block, self.share, self.again)
                    at = tops[number].leaf_of(block.bins)
                    for node in nodes:
                        rows = np.flatnonzero((at == node) & (weight > 0))
                        kept[number, node].append((block.id, lying.take(rows, 0), rest[rows], weight[rows]))
            for number, nodes in tasks[task].items():
                for node, level in nodes.items():
                    rows = sorted(kept.pop((number, node)), key=lambda r: r[0])
                    bins, rest, weight = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
                    del rows
                    yield (number, node, level), finish(bins.T, rest, weight, self.depth - level, self.per_node, self.least, [self.seed, number, node])

        return blocks.context.union([blocks.coalesce(1)] * len(tasks)).mapPartitionsWithIndex(grow).collect()
