"""Regression trees grown on histograms, alone, in forests and boosted.

Rows are packed once: a feature value becomes the number of its bin, between exact quantiles or, where there are few values,
between each two of them. A tree grows level by level. Each task adds up, per node, feature and bin, the pull of its rows
(what a leaf is to predict), their weight and number; the sums of a node meet in one place, which finds its best split, and the
driver gets one row per node. Once a node has ``LOCAL_ROWS`` rows or fewer, its rows go to one task, which grows
the rest of the tree below it in the same way; a table that small goes there as a whole, with as many trees as are
wanted. Pulls are rounded to whole multiples of a unit, so sums are exact: where rows lie and where a node is grown
changes no bit of a tree.

A model is a table with one row per tree. It is read in groups of bounded size, and a model of several
groups predicts in one task per group and block of rows, whose sums meet by row; it is never on the driver as a whole.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.draws import uniform
from tidewright.operators.quantiles import quantiles
from tidewright.session import materialize

# Places at which a column may be split, and one more: quantiles of its values, or between all values if they are fewer.
MAX_BINS = 256
# Rows below which a node is grown by one task; a table of up to so many rows is fitted there as a whole.
LOCAL_ROWS = 200_000
# Rows of a pack, nodes whose sums are formed by one job, and nodes of the trees that are sent at once.
PACK_ROWS, LEVEL_NODES, GROUP_NODES = 8192, 256, 200_000
# Boosting needs the rows anew in every round, and jobs for each cost seconds: it stays in one task up to so many times as many
# rows, if they and what a round makes of them (150 bytes a row and one for each feature) are no more than so many bytes.
BOOSTED_TIMES, BOOSTED_BYTES = 10, 400_000_000
# Boosting rounds after which the state of the rows is written anew.
KEPT_ROUNDS = 16
# Whole numbers up to here are exact in sums of doubles.
EXACT = 2.0 ** 52


@dataclass(frozen=True)
class Limits:
    """When a node is split: its depth and rows, rows and weight of both sides; ``penalty`` is added to a leaf's weight."""

    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_child_weight: float = 0.0
    penalty: float = 0.0


@dataclass
class Tree:
    """Nodes by number, the root first and children behind their parents; ``feature`` is -1 at leaves.

    Rows up to ``cut`` (bins up to ``bin``) go left. ``cover`` is the weight of a node's rows, ``count`` their number.
    """

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    count: np.ndarray

    FIELDS = {"feature": "int", "bin": "int", "cut": "double", "left": "int", "right": "int", "value": "double",
              "gain": "double", "cover": "double", "count": "bigint"}

    def _leaves(self, goes_left: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
        at = np.zeros(n, np.int64)
        active = np.flatnonzero(self.feature[at] >= 0)
        while len(active):
            node = at[active]
            at[active] = np.where(goes_left(active, node), self.left[node], self.right[node])
            active = active[self.feature[at[active]] >= 0]
        return at

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of features."""
        return self._leaves(lambda rows, node: x[rows, self.feature[node]] <= self.cut[node], len(x))

    def leaves_of_codes(self, codes: np.ndarray) -> np.ndarray:
        """The same for bins, one line per feature."""
        return self._leaves(lambda rows, node: codes[self.feature[node], rows] <= self.bin[node], codes.shape[1])

    def joined(self, below: dict[int, Tree]) -> Tree:
        """This tree with other trees in place of some of its leaves."""
        parts, size = [self], len(self.feature)
        out = Tree(**{c: getattr(self, c).copy() for c in self.FIELDS})
        for leaf, sub in below.items():
            # The root of the other tree takes the leaf's place, its other nodes follow at the end.
            moved = lambda child: np.where(child > 0, child - 1 + size, child)  # noqa: E731, B023
            for c in self.FIELDS:
                own = getattr(sub, c)
                getattr(out, c)[leaf] = moved(own)[0] if c in ("left", "right") else own[0]
            parts.append(Tree(**{c: (moved(getattr(sub, c)) if c in ("left", "right") else getattr(sub, c))[1:] for c in self.FIELDS}))
            size += len(sub.feature) - 1
        parts[0] = out
        return Tree(**{c: np.concatenate([getattr(p, c) for p in parts]) for c in self.FIELDS})

    def expected(self) -> float:
        end = self.feature < 0
        return float((self.value[end] * self.cover[end]).sum() / self.cover[0])


_TREE = "tree int, weight double, " + ", ".join(f"{c} array<{k}>" for c, k in Tree.FIELDS.items())
_TREE_NAMES = ["tree", "weight", *Tree.FIELDS]


def _tree_rows(trees: Sequence[tuple[int, float, Tree]]) -> pa.Table:
    kinds = {"int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}
    columns = [pa.array([t for t, _, _ in trees], pa.int32()), pa.array([float(w) for _, w, _ in trees], pa.float64())]
    columns += [pa.array([getattr(x, c) for _, _, x in trees], pa.list_(kinds[k])) for c, k in Tree.FIELDS.items()]
    return pa.table(columns, names=_TREE_NAMES)


def _trees_of(rows: pa.Table | pa.RecordBatch) -> list[tuple[int, float, Tree]]:
    columns = {c: rows.column(c) for c in _TREE_NAMES}
    return [(columns["tree"][i].as_py(), columns["weight"][i].as_py(),
             Tree(**{c: columns[c][i].values.to_numpy(zero_copy_only=False) for c in Tree.FIELDS})) for i in range(rows.num_rows)]


# ---------------------------------------------------------------- packs

@dataclass
class Pack:
    """Some rows: bins (one line per feature), label, weight, a number that stands for the row, and what boosting keeps of it."""

    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    state: np.ndarray

    @staticmethod
    def joined(packs: Sequence[Pack]) -> Pack:
        return Pack(*[np.concatenate([getattr(p, c) for p in packs], axis=-1) for c in ("codes", "label", "weight", "ids", "state")])


_PACK = "codes binary, label binary, weight binary, ids binary, state binary"
_PACK_NAMES = ["codes", "label", "weight", "ids", "state"]


def _packs(batches) -> Iterator[Pack]:
    for batch in batches:
        for k in range(batch.num_rows):
            codes, label, weight, ids, state = (batch.column(c)[k].as_buffer() for c in _PACK_NAMES)
            label = np.frombuffer(label, float)
            yield Pack(np.frombuffer(codes, np.uint8).reshape(-1, len(label)), label, np.frombuffer(weight, float),
                       np.frombuffer(ids, np.int64), np.frombuffer(state, float))


def _pack_rows(packs: Sequence[Pack]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([np.ascontiguousarray(getattr(p, c)).tobytes() for p in packs], pa.binary()) for c in _PACK_NAMES], names=_PACK_NAMES)


@dataclass(frozen=True)
class Packed:
    """A packed table, the places between its bins, and what is known of its labels."""

    rows: DataFrame
    cuts: tuple[np.ndarray, ...]
    n: int
    middle: float
    reach: float
    weights: float


def bin_cuts(frame: DataFrame, width: int, n: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Places between bins: halfway between all values where they are few, else even quantiles."""
    x = [f"x{i}" for i in range(width)]
    counts = frame.agg(*[F.approx_count_distinct(c).alias(c) for c in x]).first()
    few = [c for c in x if counts[c] < 1.5 * max_bins]  # the count is off by some percent at most
    out: dict[str, np.ndarray] = {}
    if few:
        row = frame.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).first()
        for c in few:
            values = np.array([v for v in row[c] if not math.isnan(v)])
            if len(values) <= max_bins:
                out[c] = (values[:-1] + values[1:]) / 2
    many = [c for c in x if c not in out]
    if many:
        found = quantiles(frame, many, [j / max_bins for j in range(1, max_bins)], at_most=n)
        out |= {c: np.unique(found[c]) for c in many}
    return [out[c] for c in x]


def pack(frame: DataFrame, weight: str | None = None, max_bins: int = MAX_BINS) -> Packed:
    """Pack a frame of ``features`` and ``label``; ``row_id`` tells rows apart where they are drawn, if there is one."""
    if not 2 <= max_bins <= 256:
        raise ValueError("the number of a bin is one byte: 2 to 256 bins")
    own = F.col("row_id").cast("long") if "row_id" in frame.columns else F.monotonically_increasing_id()
    size = frame.select(F.size(vector_to_array("features")).alias("n")).first()
    if size is None:
        raise ValueError("no rows to fit a tree on")
    width = size["n"]
    rows = frame.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"),
                        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"), own.alias("id"))
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("weight").alias("top")).first()
    flat = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)])
    cuts = bin_cuts(flat, width, known["n"], max_bins)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                held.append(batch.slice(at, PACK_ROWS))
                n += held[-1].num_rows
                if n >= PACK_ROWS:
                    yield _packed_rows(held, cuts)
                    held, n = [], 0
        if n:
            yield _packed_rows(held, cuts)

    packed = materialize(rows.mapInArrow(run, _PACK), "packs")
    middle = (known["low"] + known["high"]) / 2
    return Packed(packed, tuple(cuts), known["n"], middle, (known["high"] - known["low"]) / 2, known["top"])


def _packed_rows(batches: list[pa.RecordBatch], cuts: Sequence[np.ndarray]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    n = table.num_rows
    x = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
    codes = np.stack([np.searchsorted(cut, x[:, f], "left") for f, cut in enumerate(cuts)] or [np.zeros((0, n))]).astype(np.uint8)
    label, weight, ids = (table.column(c).to_numpy() for c in (1, 2, 3))
    return _pack_rows([Pack(codes, label, weight, ids, np.zeros(n))])


# ---------------------------------------------------------------- splits

@dataclass(frozen=True)
class Units:
    """How many units a pull and a weight of one have, so that both are whole numbers of units."""

    pull: float
    weight: float

    @staticmethod
    def of(n: int, pull: float, weight: float, whole: bool) -> Units:
        """Units so fine that ``n`` rows of such pulls and weights still add up exactly, with room for four times as much."""
        fit = lambda top: 2.0 ** math.floor(math.log2(EXACT / 4 / (max(n, 1) * top))) if top > 0 else 1.0
        return Units(fit(pull * max(weight, 1.0)), 1.0 if whole else fit(weight))

    def sums(self, pull: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Pull, weight and number of each row, in units; rows without weight do not count."""
        return np.stack([np.rint(pull * weight * self.pull), np.rint(weight * self.weight), (weight > 0).astype(float)])

    def score(self, sums: np.ndarray, penalty: float) -> np.ndarray:
        """What a node explains: squared pull by weight."""
        weight = sums[1] / self.weight + penalty
        return np.divide((sums[0] / self.pull) ** 2, weight, out=np.zeros(sums.shape[1:]), where=weight > 0)

    def value(self, sums: np.ndarray, penalty: float) -> np.ndarray:
        weight = sums[1] / self.weight + penalty
        return np.divide(sums[0] / self.pull, weight, out=np.zeros(sums.shape[1:]), where=weight > 0)


# Gains below this share of what both sides explain, and pulls that differ from the mean by less than this share, are rounding.
LEAST_GAIN, LEAST_PULL = 1e-10, 1e-12
# Gains that differ by less than this share are equal.
TIE = 1e-9


def best_splits(cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], totals: np.ndarray, limits: Limits, units: Units):
    """(gain, feature, bin, sums on the left) of the best split of each node; the feature is -1 where none is allowed.

    ``cells`` has per feature the nodes, bins and sums of all cells that hold rows, in this order. Of equal
    gains the first feature and then the lowest bin counts.
    """
    nodes = totals.shape[1]
    gain, feature, bins = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    left = np.zeros((3, nodes))
    whole, mean = units.score(totals, limits.penalty), totals[0] / np.maximum(totals[1], 1.0)
    for f, (node, at, sums) in cells.items():
        upto = np.concatenate([np.zeros((3, 1)), sums.cumsum(1)], axis=1)
        before = upto[:, np.searchsorted(node, np.arange(nodes))]
        low = upto[:, 1:] - before[:, node]
        high = totals[:, node] - low
        if limits.penalty:
            both = units.score(low, limits.penalty) + units.score(high, limits.penalty)
            own = both - whole[node]
            own[own <= LEAST_GAIN * both] = -np.inf
        else:  # from what the left side differs from the mean of the node, which loses no digits where all pulls are alike
            even = mean[node] * low[1]
            off = low[0] - even
            own = (off / units.pull) ** 2 * units.weight / np.maximum(low[1], 1.0) * (totals[1, node] / np.maximum(high[1], 1.0))
            own[np.abs(off) <= LEAST_PULL * np.maximum(np.abs(low[0]), np.abs(even))] = -np.inf
        least = max(limits.min_samples_leaf, 1)
        own[(low[2] < least) | (high[2] < least)
            | (np.minimum(low[1], high[1]) < limits.min_child_weight * units.weight)] = -np.inf
        top = np.full(nodes, -np.inf)
        np.maximum.at(top, node, own)
        first = np.flatnonzero((own >= top[node] * (1 - TIE)) & (own > -np.inf))
        at_node, place = np.unique(node[first], return_index=True)
        first = first[place]
        better = top[at_node] > gain[at_node] * (1 + TIE)
        at_node, first = at_node[better], first[better]
        gain[at_node], feature[at_node], bins[at_node] = own[first], f, at[first]
        left[:, at_node] = low[:, first]
    return gain, feature, bins, left


def _cells(codes: np.ndarray, node: np.ndarray, sums: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, bins and sums of all cells of one feature that hold rows."""
    key = node * MAX_BINS + codes
    if nodes * MAX_BINS <= 4 * len(key):
        added = np.stack([np.bincount(key, s, nodes * MAX_BINS) for s in sums])
        some = np.flatnonzero(added[2])
        return some // MAX_BINS, some % MAX_BINS, added[:, some]
    some, which = np.unique(key, return_inverse=True)
    return some // MAX_BINS, some % MAX_BINS, np.stack([np.bincount(which, s, len(some)) for s in sums])


def grow(codes: np.ndarray, sums: np.ndarray, cuts: Sequence[np.ndarray], features: Sequence[int], limits: Limits,
         units: Units, depth: int = 0) -> Tree:
    """The tree over some rows, whose root is ``depth`` levels below another one's."""
    rows = np.flatnonzero(sums[2] > 0)
    node, nodes, size = np.zeros(len(rows), np.int64), 1, 0
    totals = sums[:, rows].sum(1, keepdims=True)
    levels = []
    while nodes:
        depth_left = limits.max_depth is None or depth < limits.max_depth
        open_ = (totals[2] >= max(limits.min_samples_split, 2)) & depth_left
        gain, feature, bins, left = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((3, nodes))
        if open_.any():
            number = np.cumsum(open_) - 1
            held = open_[node]
            rows, node = rows[held], number[node[held]]
            own = sums[:, rows]
            found = {f: _cells(codes[f, rows], node, own, int(open_.sum())) for f in features}
            gain[open_], feature[open_], bins[open_], left[:, open_] = best_splits(found, totals[:, open_], limits, units)
        split = feature >= 0
        place = np.cumsum(split) - 1
        first = size + nodes + 2 * place
        levels.append(Tree(
            feature=feature, bin=bins, cut=np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature, bins, strict=True)]),
            left=np.where(split, first, -1), right=np.where(split, first + 1, -1), value=units.value(totals, limits.penalty),
            gain=gain, cover=totals[1] / units.weight, count=totals[2].astype(np.int64)))
        size, depth = size + nodes, depth + 1
        if not split.any():
            break
        # Rows of the nodes that were split, and the sums of both sides, side by side.
        of = np.flatnonzero(open_)[node]
        held = split[of]
        rows, of = rows[held], of[held]
        goes_left = codes[feature[of], rows] <= bins[of]
        node = 2 * place[of] + ~goes_left
        sides = np.stack([left[:, split], totals[:, split] - left[:, split]], axis=2)
        totals = sides.reshape(3, -1)
        nodes = totals.shape[1]
    return Tree(**{c: np.concatenate([getattr(t, c) for t in levels]) for c in Tree.FIELDS})


# ---------------------------------------------------------------- growing on Spark

#: The pull and the weight of the rows of a pack for a tree, by number.
Drawn = Callable[[Pack, int], tuple[np.ndarray, np.ndarray]]


@dataclass
class _Top:
    """The levels of a tree that are grown together: nodes so far, those to be split next and those left to one task each."""

    tree: Tree
    open: list[int] = field(default_factory=lambda: [0])
    depth: dict[int, int] = field(default_factory=lambda: {0: 0})
    local: list[int] = field(default_factory=list)


def _start() -> Tree:
    one = lambda kind, v=0: np.array([v], kind)
    return Tree(one(int, -1), one(int), one(float), one(int, -1), one(int, -1), one(float), one(float), one(float), one(int))


def _drawn_sums(drawn: Drawn, units: Units, own: Pack, tree: int) -> np.ndarray:
    return units.sums(*drawn(own, tree))


def grow_trees(packed: Packed, numbers: Sequence[int], drawn: Drawn, features: Callable[[int], Sequence[int]],
               limits: Limits, units: Units, weight: float = 1.0) -> DataFrame:
    """Trees of the given numbers as a table, each over the rows and weights drawn for it."""
    spark, cuts = packed.rows.sparkSession, packed.cuts
    if packed.n <= LOCAL_ROWS:
        lots = max(1, min(len(numbers), 2 * spark.sparkContext.defaultParallelism))

        def whole(table: pa.Table) -> pa.Table:
            own, lot = Pack.joined(list(_packs(table.to_batches()))), table.column("lot")[0].as_py()
            return _tree_rows([(t, weight, grow(own.codes, _drawn_sums(drawn, units, own, t), cuts, features(t), limits, units))
                               for t in numbers[lot::lots]])

        dealt = packed.rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        # As many tasks as lots, each with all packs; so few rows that this is no burden.
        return dealt.repartition(lots, "lot").groupBy("lot").applyInArrow(lambda t: whole(t), _TREE)
    tops = {t: _Top(_start()) for t in numbers}
    while wanted := [(t, node) for t, top in tops.items() for node in top.open][:LEVEL_NODES]:
        _grow_level(packed, tops, wanted, drawn, features, limits, units)
    return _finished(packed, tops, drawn, features, limits, units, weight)


def _grow_level(packed, tops: dict[int, _Top], wanted, drawn, features, limits, units) -> None:
    """Split the wanted nodes, whose sums are added up in tasks and by node, or leave them to one task each."""
    trees = {t: tops[t].tree for t, _ in wanted}
    width = len(packed.cuts)

    def added(batches):
        sums = {w: np.zeros((width, 3, MAX_BINS)) for w in wanted}
        for own in _packs(batches):
            for t, tree in trees.items():
                leaf, stats = tree.leaves_of_codes(own.codes), _drawn_sums(drawn, units, own, t)
                for node in (n for u, n in wanted if u == t):
                    rows = np.flatnonzero((leaf == node) & (stats[2] > 0))
                    for f in range(width):
                        code = own.codes[f, rows]
                        sums[t, node][f] += [np.bincount(code, s, MAX_BINS) for s in stats[:, rows]]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in wanted]), pa.array([n for _, n in wanted]),
                                          pa.array([sums[w].tobytes() for w in wanted], pa.binary())], names=["tree", "node", "sums"])

    def judged(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        sums = sum(np.frombuffer(b.as_buffer()).reshape(width, 3, MAX_BINS) for b in table.column("sums"))
        cells = {}
        for f in features(tree):
            some = np.flatnonzero(sums[f, 2])
            cells[f] = np.zeros(len(some), np.int64), some, sums[f][:, some]
        totals = sums[0].sum(1, keepdims=True) if width else np.zeros((3, 1))
        gain, feature, bins, left = best_splits(cells, totals, limits, units)
        return pa.table({"tree": [tree], "node": [node], "gain": gain, "feature": feature, "bin": bins,
                         "totals": [totals[:, 0].tolist()], "left": [left[:, 0].tolist()]})

    found = packed.rows.mapInArrow(added, "tree long, node long, sums binary").groupBy("tree", "node").applyInArrow(
        lambda t: judged(t), "tree long, node long, gain double, feature long, bin long, totals array<double>, left array<double>").collect()
    for r in sorted(found, key=lambda r: (r.tree, r.node)):
        top, node = tops[r.tree], r.node
        top.open.remove(node)
        totals, left = np.array(r.totals)[:, None], np.array(r.left)[:, None]
        _fill(top.tree, node, totals, limits, units)
        if totals[2, 0] <= LOCAL_ROWS:
            top.local.append(node)
        elif r.feature >= 0 and totals[2, 0] >= limits.min_samples_split and (limits.max_depth is None or top.depth[node] < limits.max_depth):
            top.tree = _with_children(top.tree, node, r, packed.cuts)
            for child, own in ((len(top.tree.feature) - 2, left), (len(top.tree.feature) - 1, totals - left)):
                _fill(top.tree, child, own, limits, units)
                top.depth[child] = top.depth[node] + 1
                (top.local if own[2, 0] <= LOCAL_ROWS else top.open).append(child)


def _fill(tree: Tree, node: int, totals: np.ndarray, limits: Limits, units: Units) -> None:
    tree.value[node], tree.cover[node] = units.value(totals, limits.penalty)[0], totals[1, 0] / units.weight
    tree.count[node] = int(totals[2, 0])


def _with_children(tree: Tree, node: int, found, cuts) -> Tree:
    size = len(tree.feature)
    blank = {"feature": -1, "left": -1, "right": -1}
    out = Tree(**{c: np.append(getattr(tree, c), [blank.get(c, 0)] * 2) for c in Tree.FIELDS})
    out.feature[node], out.bin[node], out.cut[node], out.gain[node] = found.feature, found.bin, cuts[found.feature][found.bin], found.gain
    out.left[node], out.right[node] = size, size + 1
    return out


def _finished(packed, tops: dict[int, _Top], drawn, features, limits, units, weight: float) -> DataFrame:
    """The tops with what grows below them; the rows of each node that is left go to one task."""
    spark, cuts = packed.rows.sparkSession, packed.cuts
    tree_of = {t: top.tree for t, top in tops.items()}
    left = {t: np.array(sorted(top.local)) for t, top in tops.items()}
    depth = {(t, n): top.depth[n] for t, top in tops.items() for n in top.local}

    def dealt(batches):
        for own in _packs(batches):
            out = []
            for t, tree in tree_of.items():
                leaf, (pull, weight_of) = tree.leaves_of_codes(own.codes), drawn(own, t)
                place = np.searchsorted(left[t], leaf)
                held = (weight_of > 0) & (place < len(left[t]))
                held[held] = left[t][place[held]] == leaf[held]
                for node in np.unique(leaf[held]):
                    rows = np.flatnonzero(held & (leaf == node))
                    out.append((t, int(node), np.ascontiguousarray(own.codes[:, rows]).tobytes(), units.sums(pull[rows], weight_of[rows]).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["tree", "node", "codes", "sums"])

    def below(table: pa.Table) -> pa.Table:
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        sums = [np.frombuffer(b.as_buffer()).reshape(3, -1) for b in table.column("sums")]
        codes = [np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, s.shape[1]) for b, s in zip(table.column("codes"), sums, strict=True)]
        grown = grow(np.concatenate(codes, axis=1), np.concatenate(sums, axis=1), cuts, features(t), limits, units, depth[t, node])
        return _tree_rows([(t, 1.0, grown)]).append_column("node", pa.array([node], pa.int32()))

    parts = packed.rows.mapInArrow(dealt, "tree long, node long, codes binary, sums binary").groupBy("tree", "node").applyInArrow(
        lambda t: below(t), f"{_TREE}, node int")
    top_rows = _tree_rows([(t, weight, tree) for t, tree in tree_of.items()]).append_column("node", pa.array([-1] * len(tree_of), pa.int32()))
    every = parts.unionByName(spark.createDataFrame(top_rows, parts.schema))

    def merged(table: pa.Table) -> pa.Table:
        node = table.column("node").to_pylist()
        own = dict(zip(node, (tree for _, _, tree in _trees_of(table)), strict=True))
        top = own.pop(-1)
        return _tree_rows([(table.column("tree")[0].as_py(), weight, top.joined(dict(sorted(own.items()))))])

    return every.groupBy("tree").applyInArrow(lambda t: merged(t), _TREE)


def collected(trees: DataFrame) -> list[tuple[int, float, Tree]]:
    """The trees of a table, or of a bounded part of one."""
    return sorted(_trees_of(trees.select(*_TREE_NAMES).toArrow().combine_chunks()), key=lambda t: t[0])


# ---------------------------------------------------------------- draws

# How often a row is drawn into a sample as large as the table: chances that add up, of none, once, twice and so on.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _columns_of(tree: int, width: int, share: float, seed: int) -> list[int]:
    """The features a tree may use, drawn once per tree."""
    if share >= 1:
        return list(range(width))
    order = np.argsort(uniform(np.arange(width), seed, tree, 7), kind="stable")
    return sorted(order[:max(1, int(share * width))].tolist())


# ---------------------------------------------------------------- models

@dataclass
class TreeModel:
    """Trees in a table; a prediction is ``base`` plus the weighted sum of the trees' values."""

    trees: DataFrame
    base: float
    width: int
    kind: str = "mean"

    def __post_init__(self):
        self._sizes: list[tuple[int, int]] | None = None
        self._held: list[tuple[int, float, Tree]] | None = None

    def sizes(self) -> list[tuple[int, int]]:
        """(number, nodes) of every tree."""
        if self._sizes is None:
            self._sizes = sorted(map(tuple, self.trees.select("tree", F.size("feature")).collect()))
        return self._sizes

    def lots(self) -> list[list[int]]:
        """Numbers of trees in groups of at most ``GROUP_NODES`` nodes, or of one larger tree."""
        out, held = [], GROUP_NODES + 1
        for tree, size in self.sizes():
            if held + size > GROUP_NODES:
                out.append([])
                held = 0
            out[-1].append(tree)
            held += size
        return out

    def groups(self) -> Iterator[list[tuple[int, float, Tree]]]:
        """The trees, read group by group; a single group is kept."""
        lots = self.lots()
        for lot in lots:
            if len(lots) == 1:
                self._held = self._held or collected(self.trees)
                yield self._held
            else:
                yield collected(self.trees.where(F.col("tree").between(lot[0], lot[-1])))

    def per_row(self, frame: DataFrame, kernel: Callable[[list, np.ndarray], np.ndarray], width: int, name: str) -> DataFrame:
        """``frame`` with the array ``name``: sums over the trees of what ``kernel`` gives for a group of them and a block of rows."""
        spark = frame.sparkSession
        x = vector_to_array("features")
        kernels = []
        for group in self.groups():
            kernels.append(_row_kernel(spark.sparkContext.broadcast(group), kernel, width))
            del group
        if len(kernels) == 1:
            column = F.arrow_udf(kernels[0], "array<double>")(x)
            return frame.withColumn(name, column)
        if not kernels:
            return frame.withColumn(name, F.array(*[F.lit(0.0)] * width))
        numbered = materialize(frame.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        asked = numbered.select("_row", vector_to_array("features").alias("_x"))
        parts = [asked.select("_row", F.arrow_udf(k, "array<double>")("_x").alias("_part")) for k in kernels]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        added = every.groupBy("_row").agg(F.array(*[F.sum(F.col("_part")[i]) for i in range(width)]).alias(name))
        return numbered.join(added, "_row").drop("_row")

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.per_row(df, _predicted, 1, "prediction")
        return out.withColumn("prediction", F.col("prediction")[0] + F.lit(self.base))

    def expected(self) -> float:
        """The mean prediction over the rows of the fit, by the nodes' weights."""
        row = self._over_trees(lambda weight, tree: [weight * tree.expected()], 1)
        return self.base + float(row[0])

    def _over_trees(self, kernel: Callable[[float, Tree], Sequence[float]], width: int) -> np.ndarray:
        """Sum over the trees of a few numbers each, found where the trees lie."""
        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                for _, weight, tree in _trees_of(batch):
                    total += kernel(weight, tree)
            yield pa.RecordBatch.from_arrays([pa.array(range(width)), pa.array(total)], names=["at", "part"])

        sums = self.trees.select(*_TREE_NAMES).mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("s")).collect()
        out = np.zeros(width)
        for r in sums:
            out[r["at"]] = r["s"]
        return out

    def feature_importances(self) -> np.ndarray:
        """Gain of the splits by feature: of forests the mean share within each tree, of boosted trees the mean per split."""
        width, mean = self.width, self.kind == "mean"

        def gains(_, tree):
            own = np.zeros((2, width))
            split = tree.feature >= 0
            np.add.at(own[0], tree.feature[split], tree.gain[split])
            np.add.at(own[1], tree.feature[split], 1)
            if mean:
                own[0] /= own[0].sum() or 1.0
            return own.ravel()

        total, uses = self._over_trees(gains, 2 * width).reshape(2, width)
        out = total if mean else np.divide(total, uses, out=np.zeros(width), where=uses > 0)
        return out / (out.sum() or 1.0)

    def partial_dependence(self, index: int, grid: Sequence[float]) -> np.ndarray:
        """Mean prediction with one feature known, the others as the nodes' weights have them."""
        values = np.asarray(grid, float)

        def curve(weight, tree):
            mass = np.zeros((len(tree.feature), len(values)))
            mass[0] = 1.0
            for node in np.flatnonzero(tree.feature >= 0):  # children follow their parents
                for child, inside in ((tree.left[node], values <= tree.cut[node]), (tree.right[node], values > tree.cut[node])):
                    share = inside if tree.feature[node] == index else tree.cover[child] / tree.cover[node]
                    mass[child] = mass[node] * share
            end = tree.feature < 0
            return weight * (mass[end] * tree.value[end][:, None]).sum(0)

        return self.base + self._over_trees(curve, len(values))

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        about = json.dumps({"base": self.base, "width": self.width, "kind": self.kind})
        self.trees.sparkSession.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, path: str):
        spark = SparkSession.active()
        return cls(spark.read.schema(_TREE).parquet(f"{path}/trees"), **json.loads(spark.read.parquet(f"{path}/about").first()["about"]))


def _row_kernel(sent, kernel, width: int):
    def run(x: pa.Array) -> pa.Array:
        n = len(x)
        rows = x.flatten().to_numpy(zero_copy_only=False)
        rows = rows.reshape(n, -1)
        out = np.concatenate([kernel(sent.value, rows[a:a + BLOCK_ROWS]) for a in range(0, n, BLOCK_ROWS)]) if n else np.zeros((0, width))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(out.ravel()))
    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return run


#: Rows a kernel works on at once.
BLOCK_ROWS = 2048


def _predicted(trees: list[tuple[int, float, Tree]], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for _, weight, tree in trees:
        out += weight * tree.value[tree.leaves(x)]
    return out[:, None]


@dataclass(frozen=True)
class ForestRegressor:
    """One tree over all rows, or several over samples with repeats; leaves hold the mean label of their rows."""

    n_estimators: int = 100
    limits: Limits = Limits()
    max_bins: int = MAX_BINS
    bootstrap: bool = True
    seed: int = 42
    weight: str | None = None

    def fit(self, train: DataFrame) -> TreeModel:
        packed = pack(train, self.weight, self.max_bins)
        middle, bootstrap, seed = packed.middle, self.bootstrap, self.seed
        width = len(packed.cuts)

        def drawn(own: Pack, tree: int):
            times = np.searchsorted(_DRAWS, uniform(own.ids, seed, tree), "right") if bootstrap else 1.0
            return own.label - middle, own.weight * times

        # Of n rows hardly any is drawn more than ten times.
        units = Units.of(packed.n * (2 if bootstrap else 1), packed.reach, packed.weights, whole=self.weight is None)
        numbers = list(range(self.n_estimators))
        trees = grow_trees(packed, numbers, drawn, lambda _: range(width), self.limits, units, 1.0 / self.n_estimators)
        return TreeModel(materialize(trees, "trees"), middle, width)


@dataclass(frozen=True)
class BoostedRegressor:
    """Second-order boosting of squared loss: a leaf is the sum of its residuals over their number and the penalty."""

    n_estimators: int = 100
    learning_rate: float = 0.3
    limits: Limits = Limits(6, penalty=1.0)
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    max_bins: int = MAX_BINS
    seed: int = 42

    def fit(self, train: DataFrame) -> TreeModel:
        packed = pack(train, max_bins=self.max_bins)
        units = Units.of(packed.n, 2 * packed.reach, 1.0, whole=True)
        base = packed.middle + _mean(packed, units)
        width = len(packed.cuts)
        rate, seed, share, limits = self.learning_rate, self.seed, self.subsample, self.limits

        def drawn(own: Pack, tree: int):
            taken = uniform(own.ids, seed, tree) < share if share < 1 else np.ones(len(own.ids), bool)
            return own.label - base - own.state, own.weight * taken

        columns = lambda tree: _columns_of(tree, width, self.colsample_bytree, seed)
        if packed.n <= LOCAL_ROWS * BOOSTED_TIMES and packed.n * (width + 150) <= BOOSTED_BYTES:
            trees = materialize(_boosted_at_once(packed, self.n_estimators, drawn, columns, limits, units, rate), "trees")
            return TreeModel(trees, base, width, "sum")
        grown, pending, current = [], [], packed
        for number in range(self.n_estimators):
            seen = [tree for _, _, tree in pending]

            def now(own: Pack, tree: int, seen=seen):
                return drawn(_advanced(own, seen, rate), tree)

            [found] = collected(grow_trees(current, [number], now, columns, limits, units, rate))
            grown.append(found)
            pending.append(found)
            if len(pending) == KEPT_ROUNDS:
                current, pending = replace(current, rows=_with_state(current.rows, [t for _, _, t in pending], rate)), []
        spark = train.sparkSession
        return TreeModel(materialize(spark.createDataFrame(_tree_rows(grown), _TREE), "trees"), base, width, "sum")


def _mean(packed: Packed, units: Units) -> float:
    """Mean label from the middle, from exact sums."""
    middle = packed.middle

    def run(batches):
        total = np.zeros(3)
        for own in _packs(batches):
            total += units.sums(own.label - middle, own.weight).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total[:2]], names=["pull", "weight"])

    row = packed.rows.mapInArrow(run, "pull double, weight double").agg(F.sum("pull"), F.sum("weight")).first()
    return row[0] / units.pull / (row[1] / units.weight)


def _advanced(own: Pack, trees: Sequence[Tree], rate: float) -> Pack:
    state = own.state.copy()
    for tree in trees:
        state += rate * tree.value[tree.leaves_of_codes(own.codes)]
    return replace(own, state=state)


def _with_state(rows: DataFrame, trees: Sequence[Tree], rate: float) -> DataFrame:
    def run(batches):
        for own in _packs(batches):
            yield _pack_rows([_advanced(own, trees, rate)])
    return materialize(rows.mapInArrow(run, _PACK), "boosted")


def _boosted_at_once(packed: Packed, rounds: int, drawn: Drawn, columns, limits: Limits, units: Units, rate: float) -> DataFrame:
    """All rounds over a table of few rows, in one task."""
    cuts = packed.cuts

    def run(table: pa.Table) -> pa.Table:
        own, out = Pack.joined(list(_packs(table.to_batches()))), []
        for number in range(rounds):
            tree = grow(own.codes, units.sums(*drawn(own, number)), cuts, columns(number), limits, units)
            out.append((number, rate, tree))
            own = _advanced(own, [tree], rate)
        return _tree_rows(out)

    return packed.rows.withColumn("lot", F.lit(0)).groupBy("lot").applyInArrow(lambda t: run(t), _TREE)
