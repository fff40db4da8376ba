"""Seeded clustering of genomes into a tree. Order-dependent by definition, so it runs on ids and similarity lookups at the driver.

What it needs of the data is small and bounded by the plan: a sample of pairs and the pairs that it asks for. Sets,
unions and filters stay in DataFrames.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from random import Random

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixmill.functions.hashing import node_seed, unit
from helixmill.functions.lineage import cut
from helixmill.functions.parameters import MIN_GENOMES, adaptive_bound, calibration_budget, leader_limit
from helixmill.operators.sketches import bottom_k, union_estimates

SMALLEST_CLUSTER = 10
WANTED_POSITIVES = 32
SEED = 9001


class Similarities:
    """Scores of pairs, each computed once; `score(a, b)` gives those that aren't known, `weak(a, b)` is a second sketch's for zero ones."""

    def __init__(self, score: Callable[[int, int], float], known: dict[tuple[int, int], float] | None = None, weak: Callable[[int, int], float] | None = None):
        self.score, self.weak, self.known, self.registry = score, weak, dict(known or {}), set(known or {})
        self.uncertain = {p for p, s in self.known.items() if self._weak(p, s)}

    def _weak(self, pair: tuple[int, int], score: float) -> bool:
        return score <= 0 and self.weak is not None and self.weak(*pair) > 0

    def of(self, a: int, b: int) -> float:
        pair = (a, b) if a < b else (b, a)
        if pair not in self.known:
            self.known[pair] = s = self.score(*pair)
            if self._weak(pair, s):
                self.uncertain.add(pair)
        return self.known[pair]

    def register(self, pairs: Iterable[tuple[int, int]]) -> None:
        for a, b in pairs:
            self.of(a, b)
            self.registry.add((a, b) if a < b else (b, a))

    def divided(self, parts: list[list[int]]) -> list[Similarities]:
        """What is known of the pairs within each part; a pair between two parts is of no further use below."""
        part_of = {i: k for k, part in enumerate(parts) for i in part}
        out = [Similarities(self.score, None, self.weak) for _ in parts]
        for pair, s in self.known.items():
            k = part_of.get(pair[0])
            if k is not None and k == part_of.get(pair[1]):
                out[k].known[pair] = s
                if pair in self.registry:
                    out[k].registry.add(pair)
                if pair in self.uncertain:
                    out[k].uncertain.add(pair)
        return out

    def within(self, ids: set[int]) -> list[float]:
        """Positive scores known among ids."""
        return [s for (a, b), s in self.known.items() if s > 0 and a in ids and b in ids]

    def calibration(self, ids: set[int]) -> tuple[list[float], int]:
        """Sorted positive scores of the registered pairs among ids, and how many of those pairs are confirmed zeros (uncertain ones are neither)."""
        own = [p for p in self.registry if p[0] in ids and p[1] in ids]
        scores = [self.known[p] for p in own]
        return sorted(s for s in scores if s > 0), sum(s <= 0 for s in scores) - len(self.uncertain.intersection(own))


def mean_std(values: list[float], members: int) -> tuple[float, float]:
    if members < 3 or len(values) < 2:
        return -1.0, -1.0
    mean = math.fsum(values) / len(values)
    return mean, math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1))


def percentile(positives: list[float], score: float) -> float:
    return bisect_right(positives, score) / len(positives) if positives and score > 0 else 0.0


def check_partition(ids: Iterable[int], clusters: list[list[int]]) -> list[list[int]]:
    """The clusters, if they hold each id once and nothing else."""
    flat = [i for c in clusters for i in c]
    if not all(clusters) or len(set(flat)) != len(flat) or set(flat) != set(ids):
        raise ValueError("not a partition of the node's genomes")
    return clusters


@dataclass
class Node:
    """A node's draws, all from its ids and the seed."""

    ids: list[int]
    seed: int

    def random(self, tag: str, *more: int) -> Random:
        return Random(node_seed([*self.ids, *more], int.from_bytes(tag.encode(), "big"), self.seed))

    def draw(self, tag: str, *more: int) -> float:
        return unit(node_seed(more, int.from_bytes(tag.encode(), "big"), node_seed(self.ids, 0, self.seed)))

    def panel(self, tag: str, cluster: list[int], *more: int) -> list[int]:
        """About the square root of the cluster's members, in drawn order."""
        return self.random(tag, *more).sample(cluster, min(len(cluster), math.isqrt(len(cluster)) + 1))

    def halves(self) -> list[list[int]]:
        order = self.random("halves").sample(self.ids, len(self.ids))
        return [part for part in (order[::2], order[1::2]) if part]


def cluster_genomes(ids: Iterable[int], similar: Similarities, overall: tuple[float, float], seed: int = SEED, weak: Callable[[int, int], float] | None = None) -> list[list[int]]:
    """A partition of ids: one cluster if they are few, else two or more.

    weak scores pairs whose score is zero (a second sketch); it only decides where nothing else does.
    """
    node = Node(sorted(ids), seed)
    members, n = set(node.ids), len(node.ids)
    if n < SMALLEST_CLUSTER:
        return [node.ids]
    similar.register(_more_pairs(node, similar, members))
    positives, zeros = similar.calibration(members)
    if not positives:
        return check_partition(members, node.halves())
    leaders, loose = _lead(node, similar, positives, leader_limit(n, zeros, len(positives)))
    bound = min(len(leaders), max(3, adaptive_bound(n, *mean_std(similar.within(members), n), *overall)))
    shuffled = node.random("retain").sample(leaders, len(leaders))
    ranked = sorted(shuffled, key=len, reverse=True)
    kept, loose = ranked[:bound], loose + ranked[bound:]
    for group in loose:
        kept[_nearest(node, similar, weak, group[0], kept)].extend(group)
    large = [c for c in kept if len(c) >= SMALLEST_CLUSTER]
    residual = [i for c in kept if len(c) < SMALLEST_CLUSTER for i in c]
    out = large + ([residual] if residual else [])
    if len(out) == 1 and n >= SMALLEST_CLUSTER:
        out = Node(sorted(out[0]), seed).halves()
    return check_partition(members, out)


def _more_pairs(node: Node, similar: Similarities, members: set[int]) -> list[tuple[int, int]]:
    """Unseen pairs to score until enough registered ones are positive, within the budget."""
    found, _ = similar.calibration(members)
    n = len(node.ids)
    wanted = min(WANTED_POSITIVES, n * (n - 1) // 2)
    draw, out = node.random("calibrate"), []
    tries = calibration_budget(n)
    positive = len(found)
    seen = set()
    for _ in range(4 * tries):
        if positive >= wanted or len(out) >= tries:
            break
        pair = tuple(sorted(draw.sample(node.ids, 2)))
        if pair in similar.registry or pair in seen:
            continue
        seen.add(pair)
        out.append(pair)
        positive += similar.of(*pair) > 0
    return out


def _lead(node: Node, similar: Similarities, positives: list[float], limit: int) -> tuple[list[list[int]], list[list[int]]]:
    """Genomes in drawn order join a cluster with the chance of their percentile, or lead one, or wait."""
    clusters: list[list[int]] = []
    loose: list[list[int]] = []
    for item in node.random("order").sample(node.ids, len(node.ids)):
        order = node.random("visit", item).sample(range(len(clusters)), len(clusters))
        home = next((c for c in order if any(node.draw("join", item, r, c) < percentile(positives, similar.of(item, r)) for r in node.panel("panel", clusters[c], item, c))), None)
        if home is not None:
            clusters[home].append(item)
        else:
            (clusters if len(clusters) < limit else loose).append([item])
    return clusters, loose


def _nearest(node: Node, similar: Similarities, weak, item: int, kept: list[list[int]]) -> int:
    """The cluster with the best score among its panel; by the second sketch, then by draw, where all are zero."""
    panels = [node.panel("second", c, item, i) for i, c in enumerate(kept)]
    for score in (similar.of, weak):
        if score is None:
            continue
        best = [max((score(item, r) for r in panel), default=0.0) for panel in panels]
        if max(best) > 0:
            return best.index(max(best))
    return int(node.draw("fallback", item) * len(kept))


# ---- the tree ----


@dataclass
class Tree:
    """Branches: (node_id, child_ord, filter_id, child_node_id or None, members)."""

    branches: list[tuple[int, int, int, int | None, list[int]]] = field(default_factory=list)
    nodes: int = 0

    def text(self, node: int = 0) -> str:
        """Nested parentheses of genome ids."""
        own = [b for b in self.branches if b[0] == node]
        return "(" + ",".join(self.text(b[3]) if b[3] is not None else str(b[4][0]) for b in own) + ")"


def build_tree(ids: Iterable[int], similar: Similarities, overall: tuple[float, float], seed: int = SEED, weak=None, split: Callable[[list[int]], list[list[int]]] | None = None) -> Tree:
    """A branch for each cluster, and for each genome of a node that isn't divided further; filters are numbered in pre-order.

    split may cut a cluster whose union would exceed a filter's capacity into several.
    """
    ids = sorted(ids)
    if len(ids) < MIN_GENOMES:
        raise ValueError(f"an index needs {MIN_GENOMES} genomes at least, not {len(ids)}")
    tree = Tree(nodes=1)
    filters = 0
    waiting: list[tuple[int, list[int], Similarities]] = [(0, ids, similar)]
    while waiting:  # a stack, so that depth isn't bound by Python's
        node, own, similar = waiting.pop()
        clusters = cluster_genomes(own, similar, overall, seed, weak)
        parts = [[i] for i in clusters[0]] if len(clusters) == 1 else [p for c in clusters for p in (split(c) if split else [c])]
        below = []
        for order, part in enumerate(parts):
            child = None
            if len(part) > 1:
                child = tree.nodes
                tree.nodes += 1
                below.append((child, part))
            tree.branches.append((node, order, filters, child, part))
            filters += 1
        known = similar.divided([part for _, part in below])  # a node looks at its own pairs only
        waiting += reversed([(child, part, own) for (child, part), own in zip(below, known)])
    return tree


TREE = "node_id int, child_ord int, filter_id int, child_node_id int, members array<int>"


def tree_frame(spark: SparkSession, tree: Tree) -> DataFrame:
    return spark.createDataFrame(tree.branches, TREE)


def tree_paths(tree: DataFrame, root: int = 0) -> DataFrame:
    """(filter_id, path) of the branches that end in a genome: the branches' places from the root. A join for each level."""
    level = tree.where(F.col("node_id") == root).select("filter_id", "child_node_id", F.col("child_ord").cast("string").alias("path"), "members")
    out = None
    while True:
        level = cut(level)
        ends = level.where("child_node_id is null").select("filter_id", "path", F.col("members")[0].alias("genome_id"))
        out = ends if out is None else out.unionByName(ends)
        inner = level.where("child_node_id is not null").select(F.col("child_node_id").alias("node_id"), F.col("path").alias("before"))
        if inner.isEmpty():
            return out
        level = inner.join(tree, "node_id").select("filter_id", "child_node_id", F.concat_ws("/", "before", F.col("child_ord").cast("string")).alias("path"), "members")


# ---- set forms of single steps ----


def retain_largest(sizes: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """The k largest of (cluster, size); equal sizes in seeded order."""
    turn = F.md5(F.concat_ws(":", F.lit(seed), "cluster"))
    return sizes.withColumn("turn", turn).orderBy(F.desc("size"), "turn").limit(k).drop("turn")


def best_clusters(scores: DataFrame) -> DataFrame:
    """The first of each item's best clusters, from (item, cluster, score); none where all scores are zero."""
    best = F.max_by(F.struct("cluster", "score"), F.struct("score", (-F.col("cluster")).alias("first"))).alias("b")
    return scores.where("score > 0").groupBy("item").agg(best).select("item", "b.cluster", "b.score")


def partition_faults(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: foreign, duplicate and missing genomes of (cluster, genome_id) against (genome_id)."""
    held = clusters.groupBy("genome_id").agg(F.count("*").alias("times"))
    both = ids.select("genome_id", F.lit(1).alias("expected")).join(held, "genome_id", "full")
    return both.agg(F.count_if(F.col("expected").isNull()).alias("foreign"), F.count_if(F.col("times") > 1).alias("duplicate"), F.count_if(F.col("times").isNull()).alias("missing"))


def within_capacity(sizes: dict[int, int], most: int) -> Callable[[list[int]], list[list[int]]]:
    """A split of clusters for build_tree: members join, in order, until their sizes exceed what a filter takes; the rest is a sibling, and so on."""

    def split(members: list[int]) -> list[list[int]]:
        out, held = [[]], 0
        for i in members:
            if out[-1] and held + sizes[i] > most:
                out.append([])
                held = 0
            out[-1].append(i)
            held += sizes[i]
        return out

    return split


def union_cardinalities(members: DataFrame, mz: DataFrame, keys: list[str], sketch: bool = False) -> DataFrame:
    """Distinct minimizers of each cluster: distinct rows first, so that both steps combine before they shuffle. sketch: estimated by the union of the members' sketches."""
    if sketch:
        return union_estimates(members, cut(bottom_k(mz, ["genome_id"])), "genome_id", keys).withColumnRenamed("estimate", "capacity")
    return members.join(mz, "genome_id").select(*keys, "mz").distinct().groupBy(*keys).agg(F.count("*").alias("capacity"))


def running_unions(members: DataFrame, mz: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, running): distinct minimizers of the members up to each, in order: each counts where it first occurs. mz that carries the keys isn't joined."""
    own = mz if set(keys) <= set(mz.columns) else members.join(mz, "genome_id")
    first = own.groupBy(*keys, "mz").agg(F.min(order).alias(order))
    new = first.groupBy(*keys, order).agg(F.count("*").alias("new"))
    whole = members.select(*keys, order).distinct().join(new, [*keys, order], "left")
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return whole.select(*keys, order, F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("running"))

