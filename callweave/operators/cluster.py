"""Clustering of calls: order-free components, and ordered agglomeration under constraints.

Components (no sample rule, no constraint) are found by alternating neighbour contraction in DataFrame joins.  The
ordered form is sequential by nature: edges join clusters nearest first, so it runs as one Python function per component of the pair
graph, fed with the pairs that Catalyst found and judged; no cluster crosses components, and each is a part of one shard.
Calls without a pair, the large majority, never reach Python.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.config import EPSILON, MergeConfig
from callweave.functions.masks import as_words
from callweave.operators.pairs import candidate_pairs
from callweave.session import cut, shuffle_width


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one task as stars: each node joined to the smallest of its component within the task."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        top = i
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[i] != top:
            root[i], i = top, root[i]
        return top

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    stars = [(find(i), i) for i in root]
    yield pd.DataFrame([s for s in stars if s[0] != s[1]], columns=["u", "v"])


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): connected components, named by their smallest node.

    Every task first turns its own edges into stars, which leaves little to do where near nodes have near numbers.  Then each round
    links a node's larger neighbours, then its smaller ones, to the smallest neighbour; paths shorten geometrically.  Stops when only stars
    are left.  Nodes without edges are their own component.
    """
    links = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v")
    current = cut(links.repartitionByRange(shuffle_width(edges.sparkSession), "u").mapInPandas(_forest, "u bigint, v bigint"))
    for _ in range(most_rounds):
        ends = current.select(F.col("u").alias("n"), F.lit(0).alias("d")).distinct().unionByName(current.select(F.col("v").alias("n"), F.lit(1).alias("d")))
        if ends.groupBy("n").agg(F.count("*").alias("c"), F.max("d").alias("d")).filter("c > 1 and d = 1").isEmpty():
            break
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v"), F.col("_m").alias("u")).filter("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("_m"))
        small = large.join(down, "v").select(F.when(F.col("u") == F.col("_m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("_m").alias("u"))
        current = cut(small.filter("u <> v").select("u", "v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select("node").join(current.select(F.col("v").alias("node"), F.col("u").alias("_root")), "node", "left").select("node", F.coalesce("_root", "node").alias("component"))


class _Offer:
    """A pair on offer: nearer first; distances within a billionth of each other are ties and go by ``tie``."""

    __slots__ = ("near", "tie")

    def __init__(self, near: int, tie: tuple):
        self.near, self.tie = near, tie

    def __lt__(self, other: _Offer) -> bool:
        if abs(self.near - other.near) > 1:
            return self.near < other.near
        return self.tie < other.tie


class Forest:
    """Union-find over calls with sample masks, bounding boxes and member lists."""

    def __init__(self, points: list[tuple[float, float]], masks: list[int], exclusive: bool):
        n = len(points)
        self.parent, self.size, self.mask = list(range(n)), [1] * n, list(masks)
        self.box = [(x, x, y, y) for x, y in points]
        self.members = [[i] for i in range(n)]
        self.exclusive = exclusive

    def find(self, i: int) -> int:
        root = i
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[i] != root:
            self.parent[i], i = root, self.parent[i]
        return root

    def allowed(self, a: int, b: int) -> bool:
        return not self.exclusive or not self.mask[a] & self.mask[b]

    def union(self, a: int, b: int) -> None:
        """Roots a (asking side) and b: the larger stays; of equal ones b does."""
        keep, gone = (a, b) if self.size[a] > self.size[b] else (b, a)
        self.parent[gone] = keep
        self.size[keep] += self.size[gone]
        self.mask[keep] |= self.mask[gone]
        p, q = self.box[keep], self.box[gone]
        self.box[keep] = (min(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]))
        self.members[keep] += self.members[gone]
        self.members[gone] = []


def agglomerate(calls: list[dict], pairs: list[tuple[int, int, float, bool, bool]], cfg: MergeConfig) -> list[int]:
    """The cluster of each call (smallest member position) by nearest-first agglomeration.

    ``calls`` are in index order with start, end, max_dist, mask, hash, rank and trid; ``pairs`` hold positions (a, b),
    their distance and which side asks.  Each call offers its partners one at a time, nearest first, ties by position; a heap takes the
    nearest offer of all, ties by the two hashes, the two id ranks and the positions.  A refused offer is dropped, the
    asker goes on to its next partner.
    """
    n = len(calls)
    queue: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for a, b, dist, a_asks, b_asks in pairs:
        if a_asks:
            queue[a].append((dist, b))
        if b_asks:
            queue[b].append((dist, a))
    for q in queue:
        q.sort(reverse=True)
    points = [(c["start"], c["end"]) for c in calls]
    forest = Forest(points, [c["mask"] for c in calls], not cfg.allow_intrasample)

    def far(a: int, b: int) -> float:
        return math.sqrt((points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2)

    def limit(a: int, b: int) -> float:
        x, y = calls[a], calls[b]
        if x["trid"] is not None and x["trid"] == y["trid"]:
            return cfg.tr_max_dist
        return (max if cfg.no_mutual_distance else min)(x["max_dist"], y["max_dist"])

    def fits(a: int, b: int, ra: int, rb: int) -> bool:
        if cfg.merge_constraint == "bbox_diameter":
            p, q = forest.box[ra], forest.box[rb]
            wide = max(p[1], q[1]) - min(p[0], q[0])
            high = max(p[3], q[3]) - min(p[2], q[2])
            return math.sqrt(wide * wide + high * high) <= limit(a, b) + EPSILON
        if cfg.merge_constraint == "clique":
            for i in forest.members[ra]:
                for j in forest.members[rb]:
                    ti, tj = calls[i]["trid"], calls[j]["trid"]
                    if (ti is not None and tj is not None and ti != tj) or far(i, j) > limit(i, j) + EPSILON:
                        return False
            return True
        if cfg.merge_constraint == "centroid":
            both = forest.members[ra] + forest.members[rb]
            cx, cy = sum(points[i][0] for i in both) / len(both), sum(points[i][1] for i in both) / len(both)
            return all(math.sqrt((points[i][0] - cx) ** 2 + (points[i][1] - cy) ** 2) <= calls[i]["max_dist"] + EPSILON for i in both)
        return True

    def offer(a: int, b: int, dist: float) -> _Offer:
        x, y = calls[a], calls[b]
        return _Offer(math.floor(dist * 1e9 + 0.5), (x["hash"], y["hash"], x["rank"], y["rank"], a, b))

    heap = [offer(i, i, 0.0) for i in range(n)]
    heapq.heapify(heap)
    while heap:
        a, b = heapq.heappop(heap).tie[-2:]
        if a != b:
            ra, rb = forest.find(a), forest.find(b)
            if ra != rb and forest.allowed(ra, rb) and fits(a, b, ra, rb):
                forest.union(ra, rb)
        if queue[a]:
            dist, partner = queue[a].pop()
            heapq.heappush(heap, offer(a, partner, dist))
    least: dict[int, int] = {}
    for i in range(n):
        least.setdefault(forest.find(i), i)
    return [least[forest.find(i)] for i in range(n)]


_WORD = (1 << 64) - 1


def _solve(cfg: MergeConfig):
    def run(calls: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        """Several components, one after another."""
        if not len(calls):
            return pd.DataFrame({"block": [], "idx": [], "group_id": []})
        edges = dict(list(pairs.groupby("pair_comp")))
        return pd.concat([one(part, edges[comp]) for comp, part in calls.groupby("comp")])

    def one(calls: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        calls = calls.sort_values("idx").reset_index(drop=True)
        ids = calls["idx"].tolist()
        place = {v: i for i, v in enumerate(ids)}
        ranks = calls.sort_values(["id", "idx"], key=lambda c: c.map(lambda v: v.encode()) if c.name == "id" else c).index
        rank = {int(i): r for r, i in enumerate(ranks)}
        rows = [
            {"start": c.start, "end": c.end, "max_dist": c.max_dist, "mask": sum((int(v) & _WORD) << 64 * k for k, v in enumerate(c.support_mask)) or 1 << int(c.sample_id), "hash": int(c.info_hash), "rank": rank[i], "trid": c.trid if isinstance(c.trid, str) else None}
            for i, c in enumerate(calls.itertuples(index=False))
        ]
        edges = [(place[p.a], place[p.b], p.dist, p.a_asks, p.b_asks) for p in pairs.itertuples(index=False)]
        group = agglomerate(rows, edges, cfg)
        return pd.DataFrame({"block": calls["block"], "idx": ids, "group_id": [ids[g] for g in group]})

    return run


#: Calls of small components that one Python call takes together.
_TOGETHER = 2000


def cluster_calls(calls: DataFrame, cfg: MergeConfig) -> DataFrame:
    """(block, idx, group_id): the cluster of each call, named by its smallest idx.

    ``idx`` is unique.  Pairs are found and judged by Catalyst, components of the pair graph by joins; only calls with a pair go
    to Python, small components many at a time.  A component is never cut, so the result is that of one run over everything.
    An empty input gives an empty result.
    """
    calls = as_words(calls)
    pairs = cut(candidate_pairs(calls, cfg))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    found = components(ends, pairs.select("a", "b")).select(F.col("node").alias("idx"), F.col("component").alias("comp"))
    # Small components share a Python call, large ones have their own.
    sizes = found.groupBy("comp").agg(F.count("*").alias("_n"))
    bins = F.greatest(F.lit(1), F.floor(F.lit(ends.count()) / _TOGETHER))
    own = F.struct(F.lit(True).alias("large"), F.col("comp").alias("number"))
    together = F.struct(F.lit(False).alias("large"), F.pmod(F.xxhash64("comp"), bins).alias("number"))
    home = cut(found.join(sizes, "comp").select("idx", "comp", F.when(F.col("_n") > _TOGETHER, own).otherwise(together).alias("bin")))
    columns = ["block", "idx", "id", "start", "end", "max_dist", "support_mask", "sample_id", "info_hash", "trid"]
    busy = calls.select(*columns).join(home, "idx")
    placed = home.select(F.col("idx").alias("a"), F.col("comp").alias("pair_comp"), F.col("bin").alias("pair_bin"))
    edges = pairs.select("a", "b", "dist", "a_asks", "b_asks").join(placed, "a")
    solved = busy.groupBy("bin").cogroup(edges.groupBy("pair_bin")).applyInPandas(_solve(cfg), "block string, idx bigint, group_id bigint")
    alone = calls.select("block", "idx").join(home, "idx", "left_anti").select("block", "idx", F.col("idx").alias("group_id"))
    return solved.unionByName(alone)
