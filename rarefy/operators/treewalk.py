"""Row-local scoring: every tree of an ensemble walked inside the row.

The node tables of all trees become a few constant arrays (feature, threshold,
categories, children, leaf value), which Catalyst folds into literals.  A row
walks them with one higher-order expression for all trees, so scoring adds no
exchange, no generator and no step per tree to the plan, and a stream is
scored like a batch.  The arrays are model sized; trees are taken in groups of
at most ``max_nodes`` nodes, each group one expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind

# Nodes of one group of constant arrays (some 10 MB of literals).
MAX_NODES = 500_000
# Categories of a split travel as the bits of 64-bit integers, this many in each.
WORD_BITS = 62


@dataclass
class TreeGroup:
    """Some whole trees as parallel lists; a leaf has feature -1 and is its own child."""
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    first_word: list[int] = field(default_factory=list)  # of a node's categories, or -1
    n_words: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    depth: int = 0

    def add(self, nodes: Sequence[tuple]) -> None:
        """One tree: (id, feature or None, threshold, categories, left id, right id, value),
        the root first."""
        base = len(self.feature)
        place = {n[0]: base + i for i, n in enumerate(nodes)}
        level = {nodes[0][0]: 0}
        self.roots.append(base)
        for node, f, t, c, left, right, value in nodes:
            leaf = f is None
            self.feature.append(-1 if leaf else int(f))
            self.threshold.append(0.0 if leaf or t is None else float(t))
            mask = 0 if leaf or not c else int(c)
            self.first_word.append(len(self.words) if mask else -1)
            self.n_words.append(-(-mask.bit_length() // WORD_BITS))
            while mask:
                self.words.append(mask & ((1 << WORD_BITS) - 1))
                mask >>= WORD_BITS
            self.left.append(place[node] if leaf else place[left])
            self.right.append(place[node] if leaf else place[right])
            self.value.append(float(value))
            if not leaf:
                level[left] = level[right] = level[node] + 1
        self.depth = max(self.depth, *level.values())


def group_trees(trees: Iterable[Sequence[tuple]], max_nodes: int = MAX_NODES) -> list[TreeGroup]:
    """Trees in order, packed into groups of at most ``max_nodes`` nodes (one tree at least)."""
    groups: list[TreeGroup] = []
    for nodes in trees:
        if not groups or len(groups[-1].feature) + len(nodes) > max_nodes:
            groups.append(TreeGroup())
        groups[-1].add(nodes)
    return groups


def category_mask(categories: Iterable[float]) -> int:
    """Bit c is set for every category c that goes left."""
    mask = 0
    for c in categories:
        if c < 0:
            raise ValueError("categories are numbered from 0")
        mask |= 1 << int(c)
    return mask


def _constant(values: Sequence, kind: str) -> Column:
    """A literal array: one folded expression, however many values."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def tree_values(x: Column, groups: Sequence[TreeGroup]) -> Column:
    """Leaf value of every tree, in tree order, for the feature array ``x``.

    ``value <= threshold`` goes left; NULL and NaN go right.
    """

    def one_group(xs: Column, g: TreeGroup) -> Column:
        # A leaf leads to itself whatever it compares, so a step need not tell leaves apart.
        feature = _constant([max(f, 0) for f in g.feature], "int")
        left, right = _constant(g.left, "int"), _constant(g.right, "int")
        threshold, value = _constant(g.threshold, "double"), _constant(g.value, "double")
        categorical = bool(g.words)
        if categorical:
            first, spans = _constant(g.first_word, "int"), _constant(g.n_words, "int")
            words = _constant(g.words, "bigint")

        def step(n: Column, _: Column) -> Column:
            v = F.get(xs, F.get(feature, n))
            ok = v <= F.get(threshold, n)  # NULL counts as false below
            if categorical:
                code = v.cast("int")
                word = words[first[n] + F.floor(code / F.lit(WORD_BITS)).cast("int")]
                inside = F.when((v >= 0) & (v < spans[n] * F.lit(WORD_BITS)),
                                F.getbit(word, code % F.lit(WORD_BITS)) == 1).otherwise(F.lit(False))
                ok = F.when(first[n] >= 0, F.coalesce(inside, F.lit(False))).otherwise(ok)
            return F.when(ok, F.get(left, n)).otherwise(F.get(right, n))

        def leaf(root: Column) -> Column:
            if not g.depth:
                return value[root]
            end = F.aggregate(F.sequence(F.lit(1), F.lit(g.depth)), root, step)
            return value[end]

        return F.transform(_constant(g.roots, "int"), leaf)

    def all_groups(xs: Column) -> Column:
        parts = [one_group(xs, g) for g in groups]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return bind(x, all_groups)


def with_tree_values(df: DataFrame, x: Column, groups: Sequence[TreeGroup],
                     output: str = "p1s") -> DataFrame:
    """``df`` with the array of leaf values; rows and their order are unchanged."""
    return df.withColumn(output, tree_values(x, groups) if groups else F.array().cast("array<double>"))
