"""The k nearest vectors of every vector, by adaptive dimension scan over probed lists.

Vectors are rotated once and cut into lists of about ``LIST_SIZE`` vectors that lie near each other (equal-count
strips along the first rotated axis, each cut along the second).  A list is scanned block of columns by block:
partial squared distances grow, and a candidate is abandoned as soon as a test on what has been seen so far
says that it can't be among the k nearest.  Two tests apply to the partial distance p over d of D rotated columns
against the current k-th distance t: the bound p > t, which never errs, and the hypothesis test
p * sqrt(D / d) > t * (1 + eps / sqrt(d)), which errs with a probability that falls with eps.  With ``lossless`` only
the bound is used; for the plane it is the sharper of the two, so the result for points is exact.

First each list is scanned for its own members, which bounds their k-th distance; then members look into each other
list that comes within that bound.  Every list near enough is probed, so nothing is lost between lists.

``nearest_vectors`` is the form for vectors of any width: lists around centres fitted on a bounded sample, a few lists probed, the
hypothesis test in use; ``nearest_points`` is the exact form for the plane.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.prefix import prefix_scan
from callweave.session import cut

LIST_SIZE = 512
#: Probes of one list that one task scans at a time; a list probed more often is scanned in several tasks.
PROBES_PER_TASK = 20_000
EPSILON = 2.1
_ANGLE = 0.7390851332


def abandoned(partial: np.ndarray, limit: np.ndarray, seen: int, total: int, lossless: bool, epsilon: float = EPSILON) -> np.ndarray:
    """Which candidates the tests rule out, given partial squared distances and the squared k-th distance."""
    out = partial > limit
    if not lossless and seen < total:
        out |= partial * (total / seen) > limit * (1 + epsilon / math.sqrt(seen)) ** 2
    return out


def scan_list(
    queries: np.ndarray, candidates: np.ndarray, limit: np.ndarray, blocks: list[int], lossless: bool = True, same: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that survive all column blocks; ``same`` holds the candidates' own query or -1."""
    width = queries.shape[1]
    first = slice(0, blocks[0])
    partial = np.zeros((len(queries), len(candidates)))
    for c in range(first.start, first.stop):
        partial += (queries[:, c, None] - candidates[None, :, c]) ** 2
    alive = ~abandoned(partial, limit[:, None], blocks[0], width, lossless)
    if same is not None:
        alive[same[same >= 0], np.flatnonzero(same >= 0)] = False
    q, c = np.nonzero(alive)
    partial = partial[q, c]
    for begin, end in zip(blocks, blocks[1:]):
        partial = partial + ((queries[q, begin:end] - candidates[c, begin:end]) ** 2).sum(axis=1)
        keep = ~abandoned(partial, limit[q], end, width, lossless)
        q, c, partial = q[keep], c[keep], partial[keep]
    return q, c


def _best(q: np.ndarray, d2: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best rows of each query, by distance, then id."""
    order = np.lexsort((ident, d2, q))
    sorted_q = q[order]
    begin = np.flatnonzero(np.r_[True, sorted_q[1:] != sorted_q[:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return order[rank < k]


def _flat(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Candidate rows: the owner's position and the id, for each id of each place."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.repeat(np.arange(len(ids)), sizes), np.concatenate(list(ids)) if len(ids) else np.zeros(0, dtype=np.int64)


def _slack(*arrays: np.ndarray) -> float:
    """What rotation may add to a distance through rounding."""
    return 8 * np.finfo(float).eps * max((float(np.abs(a).max()) for a in arrays if len(a)), default=0.0)


def places(points: DataFrame, ident: str, block: str, x: str, y: str, k: int) -> DataFrame:
    """Distinct places of a block with their k + 1 smallest ids; more are never needed from one place.

    The rank filter is pushed below the shuffle, so that many points at one place send only k + 1 rows per task.
    """
    valid = points.select(
        F.col(ident).alias("id"), F.col(block).alias("block"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y")
    ).filter(F.col("block").isNotNull() & F.col("id").isNotNull())
    for c in ("x", "y"):
        valid = valid.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rank = F.row_number().over(Window.partitionBy("block", "x", "y").orderBy("id"))
    few = valid.withColumn("_r", rank).filter(F.col("_r") <= k + 1).drop("_r")
    return few.groupBy("block", "x", "y").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def into_lists(located: DataFrame, size: int = LIST_SIZE) -> DataFrame:
    """Adds rotated coordinates and (strip, cell), the list of each place.

    Ranks along the first axis come from a running count that splits large blocks over tasks; a strip has about
    sqrt(n * size) places and is sorted in one task.
    """
    cos, sin = math.cos(_ANGLE), math.sin(_ANGLE)
    turned = located.select(
        "*",
        (F.col("x") * cos - F.col("y") * sin).alias("u"),
        (F.col("x") * sin + F.col("y") * cos).alias("v"),
        F.col("ids")[0].alias("rep"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    ranked = prefix_scan(turned, ["block"], ["u", "rep"], {"_rank": ("sum", "_one")})
    sizes = located.groupBy("block").agg(F.count("*").alias("_n"))
    strip = F.floor((F.col("_rank") - 1) / F.ceil(F.sqrt(F.col("_n") * F.lit(float(size)))))
    striped = ranked.join(sizes, "block").withColumn("strip", strip).drop("_one", "_rank", "_n")
    inner = F.row_number().over(Window.partitionBy("block", "strip").orderBy("v", "rep"))
    return striped.withColumn("cell", F.floor((inner - 1) / size))


def _own_list(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        owner, ids = _flat(group["ids"])
        xy, uv = group[["x", "y"]].to_numpy(), group[["u", "v"]].to_numpy()
        n, limit = len(group), np.full(len(group), np.inf)
        if len(ids) > k + 1:
            # A first bound: the k-th distance among candidates next to the query along the first axis.
            order = np.argsort(uv[owner, 0], kind="stable")
            at = np.searchsorted(uv[owner, 0][order], uv[:, 0])
            reach = 3 * k + 3
            near = np.clip(at[:, None] + np.arange(-reach, reach + 1)[None, :], 0, len(order) - 1)
            near = np.sort(near, axis=1)
            fresh = np.c_[np.ones(n, dtype=bool), near[:, 1:] != near[:, :-1]]
            c = order[near]
            d2 = ((xy[:, None, :] - xy[owner[c]]) ** 2).sum(axis=2)
            d2[~fresh | (owner[c] == np.arange(n)[:, None])] = np.inf
            if d2.shape[1] >= k:
                limit = np.partition(d2, k - 1, axis=1)[:, k - 1]
        wide = (np.sqrt(limit) + _slack(uv)) ** 2
        same = owner
        q, c = scan_list(uv, uv[owner], wide, [1, 2], same=same)
        d2 = ((xy[q] - xy[owner[c]]) ** 2).sum(axis=1)
        top = _best(q, d2, ids[c], k)
        q, c, d2 = q[top], c[top], d2[top]
        count = np.bincount(q, minlength=n)
        worst = np.zeros(n)
        np.maximum.at(worst, q, d2)
        worst[count < k] = np.inf
        lists = np.split(np.arange(len(q)), np.cumsum(count)[:-1])
        u, v = uv[:, 0], uv[:, 1]
        border = np.minimum.reduce([u - u.min(), u.max() - u, v - v.min(), v.max() - v])
        return pd.DataFrame(
            {
                "rep": group["rep"],
                "block": group["block"],
                "strip": group["strip"],
                "cell": group["cell"],
                "x": group["x"],
                "y": group["y"],
                "u": u,
                "v": v,
                "tau": np.sqrt(worst) + _slack(uv),
                "inside": border > np.sqrt(worst) + _slack(uv),
                "near": [ids[c[i]].tolist() for i in lists],
                "d2": [d2[i].tolist() for i in lists],
            }
        )

    return run


_OWN_SCHEMA = (
    "rep bigint, block string, strip bigint, cell bigint, x double, y double, u double, v double, tau double, inside boolean, near array<bigint>, d2 array<double>"
)


def _probe(k: int):
    def run(probes: pd.DataFrame, content: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(content):
            return pd.DataFrame({"rep": [], "near": [], "d2": []})
        owner, ids = _flat(content["ids"])
        xy, uv = content[["x", "y"]].to_numpy()[owner], content[["u", "v"]].to_numpy()[owner]
        out = []
        for a in range(0, len(probes), 1024):
            part = probes.iloc[a : a + 1024]
            mine = part[["x", "y"]].to_numpy()
            q, c = scan_list(part[["u", "v"]].to_numpy(), uv, part["tau"].to_numpy() ** 2, [1, 2])
            d2 = ((mine[q] - xy[c]) ** 2).sum(axis=1)
            top = _best(q, d2, ids[c], k)
            out.append(pd.DataFrame({"rep": part["rep"].to_numpy()[q[top]], "near": ids[c[top]], "d2": d2[top]}))
        return pd.concat(out)

    return run


def nearest_places(located: DataFrame, k: int, size: int = LIST_SIZE) -> DataFrame:
    """(rep, near, d2): for each place the k nearest points of other places, by distance and id."""
    lists = cut(into_lists(located, size))
    where = ["block", "strip", "cell"]
    own = cut(lists.groupBy(*where).applyInPandas(_own_list(k), _OWN_SCHEMA))
    boxes = lists.groupBy(*where).agg(*[f(c).alias(f"{c}_{n}") for c in ("u", "v") for n, f in (("lo", F.min), ("hi", F.max))])
    strips = boxes.groupBy("block", F.col("strip").alias("strip2")).agg(F.min("u_lo").alias("s_lo"), F.max("u_hi").alias("s_hi"))
    wide = own.filter(~F.col("inside")).groupBy(*where).agg(F.max("tau").alias("reach"))
    asking = boxes.join(wide, where)
    in_strip = asking.join(strips, "block").filter((F.col("s_lo") <= F.col("u_hi") + F.col("reach")) & (F.col("s_hi") >= F.col("u_lo") - F.col("reach")))
    others = boxes.select("block", *[F.col(c).alias(f"{c}2") for c in ("strip", "cell")], *[F.col(c).alias(f"o_{c}") for c in ("u_lo", "u_hi", "v_lo", "v_hi")])
    facing = (
        in_strip.join(others, ["block", "strip2"])
        .filter((F.col("strip") != F.col("strip2")) | (F.col("cell") != F.col("cell2")))
        .filter((F.col("o_v_lo") <= F.col("v_hi") + F.col("reach")) & (F.col("o_v_hi") >= F.col("v_lo") - F.col("reach")))
        .select(*where, "strip2", "cell2", "o_u_lo", "o_u_hi", "o_v_lo", "o_v_hi")
    )
    gap = lambda c: F.greatest(F.col(f"o_{c}_lo") - F.col(c), F.col(c) - F.col(f"o_{c}_hi"), F.lit(0.0))
    probes = (
        own.filter(~F.col("inside"))
        .join(facing, where)
        .filter(gap("u") * gap("u") + gap("v") * gap("v") <= F.col("tau") * F.col("tau"))
        .select("rep", "block", F.col("strip2").alias("strip"), F.col("cell2").alias("cell"), "x", "y", "u", "v", "tau")
    )
    probes = cut(probes)
    tasks = probes.groupBy(*where).agg(F.ceil(F.count("*") / PROBES_PER_TASK).alias("parts"))
    probes = probes.join(tasks, where).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("parts")
    content = lists.join(tasks, where).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    content = content.select(*where, "part", "x", "y", "u", "v", "ids")
    by = [*where, "part"]
    found = probes.groupBy(*by).cogroup(content.groupBy(*by)).applyInPandas(_probe(k), "rep bigint, near bigint, d2 double")
    mine = own.select("rep", F.explode(F.arrays_zip("near", "d2")).alias("_z")).select("rep", "_z.near", "_z.d2")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("d2", "near"))
    return mine.unionByName(found).withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def nearest_points(points: DataFrame, ident: str, block: str, x: str, y: str, k: int, size: int = LIST_SIZE) -> DataFrame:
    """(point, neighbour, rank, distance): the k nearest points of each point within its block.

    Distances are squared Euclidean, computed from the original coordinates; ties go to the smaller id; a point
    is not its own neighbour.  Points with a null, NaN or infinite coordinate, a null block or a null id take no
    part; a point alone in its block has no row; one with fewer than k others has all of them.  Ids are unique.
    """
    located = cut(places(points, ident, block, x, y, k))
    far = nearest_places(located, k, size)
    lists = far.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("d2", "near"))).alias("far"))
    here = located.withColumn("rep", F.col("ids")[0]).join(lists, "rep", "left")
    own = here.select("ids", "far", F.explode("ids").alias("point"))
    zero = F.transform(F.filter("ids", lambda i: i != F.col("point")), lambda i: F.struct(F.lit(0.0).alias("d2"), i.alias("near")))
    empty = F.array().cast("array<struct<d2:double,near:bigint>>")
    both = F.slice(F.concat(zero, F.coalesce("far", empty)), 1, k)
    first = own.select("point", F.posexplode(both).alias("rank", "_n")).select("point", F.col("_n.near").alias("neighbour"), "rank", F.col("_n.d2").alias("distance"))
    # Points beyond the first k + 1 of their place: their neighbours are the first k of it.
    crowded = located.filter(F.size("ids") > k).select("block", "x", "y", "ids")
    rest = (
        points.select(F.col(ident).alias("point"), F.col(block).alias("block"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"))
        .filter(F.col("point").isNotNull())
        .join(crowded, ["block", "x", "y"])
        .filter(~F.array_contains("ids", F.col("point")))
        .select("point", F.posexplode(F.slice("ids", 1, k)).alias("rank", "neighbour"))
        .select("point", "neighbour", "rank", F.lit(0.0).alias("distance"))
    )
    return first.unionByName(rest).withColumn("rank", (F.col("rank") + 1).cast("int"))


#: Vectors that the centres are fitted on; every vector is put into a list.
FIT_SAMPLE = 20_000
#: How many lists a query looks into is set on the sample: enough to hold this share of the nearest of ``TRIAL`` sampled queries.
HELD, TRIAL = 0.98, 400
#: Vectors of a list that one task scans; a longer list is scanned in parts.
PART_SIZE = 20_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.tolist()).astype(np.float64) if len(vectors) else np.zeros((0, 1))


def _centres(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), count, replace=False)]
    for _ in range(rounds):
        home = (-2 * sample @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        total, size = np.zeros_like(centres), np.bincount(home, minlength=count)
        np.add.at(total, home, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """Lists to probe so that ``HELD`` of the sampled queries' nearest vectors in the sample lie in them.

    In the whole table the nearest are nearer than in the sample, so their lists come earlier still.
    """
    home = (-2 * sample @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
    size, places = (sample**2).sum(axis=1), []
    for q in range(0, len(sample), max(1, len(sample) // TRIAL)):
        d2 = size - 2 * sample @ sample[q]
        d2[q] = np.inf
        nearest = np.argpartition(d2, min(k, len(d2)) - 1)[:k]
        order = np.argsort(((centres - sample[q]) ** 2).sum(axis=1), kind="stable")
        places.append(np.argsort(order)[home[nearest]])
    return int(np.quantile(np.concatenate(places), HELD)) + 1 if places else 1


def _blocks(width: int) -> list[int]:
    """Ends of the column blocks: each doubles what has been seen."""
    ends = [max(1, min(width, 8))]
    while ends[-1] < width:
        ends.append(min(width, ends[-1] * 2))
    return ends


def _scan_part(k: int):
    def run(asking: pd.DataFrame, content: pd.DataFrame) -> pd.DataFrame:
        """The k best of a part of a list for each query that probes it; the k-th distance so far shrinks from piece to piece."""
        if not len(asking) or not len(content):
            return pd.DataFrame({"query": [], "near": [], "d2": []})
        q, c = _matrix(asking["rotated"]), _matrix(content["rotated"])
        q_id, c_id = asking["query"].to_numpy(), content["id"].to_numpy()
        limit = np.full(len(q), np.inf)
        best_q, best_id, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        blocks = _blocks(q.shape[1])
        for a in range(0, len(c), 512):
            piece = c[a : a + 512]
            for b in range(0, len(q), 512):
                at, of = scan_list(q[b : b + 512], piece, limit[b : b + 512], blocks, lossless=False)
                at = at + b
                keep = q_id[at] != c_id[a + of]
                at, of = at[keep], of[keep]
                best_q, best_id = np.r_[best_q, at], np.r_[best_id, c_id[a + of]]
                best_d = np.r_[best_d, ((q[at] - piece[of]) ** 2).sum(axis=1)]
            top = _best(best_q, best_d, best_id, k)
            best_q, best_id, best_d = best_q[top], best_id[top], best_d[top]
            full = np.bincount(best_q, minlength=len(q)) >= k
            worst = np.zeros(len(q))
            np.maximum.at(worst, best_q, best_d)
            limit = np.where(full, worst, np.inf)
        return pd.DataFrame({"query": q_id[best_q], "near": best_id, "d2": best_d})

    return run


def nearest_vectors(vectors: DataFrame, ident: str, vector: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query, near, rank, d2): about the k nearest vectors of each query by squared Euclidean distance, ties by id; not the query itself.

    ``queries`` has the same columns and is ``vectors`` if not given.  All vectors are in the index; losses come from lists
    that aren't probed (see ``HELD``) and from the hypothesis test (see ``EPSILON``).  Vectors that are null, hold a null or a number that isn't finite,
    or differ in width from the first by id take no part.  Ids are unique.  An empty table gives no row.
    """
    spark = vectors.sparkSession

    def tidy(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    rows = tidy(vectors)
    first = rows.agg(F.min_by(F.size("v"), "id"), F.count("*")).first()
    width, count = first[0] or 1, first[1]
    rows = rows.filter(F.size("v") == width)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_SAMPLE).toPandas()
    n_lists = int(max(1, min(len(sample) // 8, math.isqrt(count), 4096)))
    rotation = np.linalg.qr(np.random.default_rng(17).normal(size=(width, width)))[0]
    turned = _matrix(sample["v"]) @ rotation if len(sample) else np.zeros((0, width))
    centres = _centres(turned, n_lists) if len(sample) else np.zeros((1, width))
    probed = min(n_lists, _probes(turned, centres, k))
    shared = spark.sparkContext.broadcast((rotation, centres))  # width x width and at most 4096 x width numbers

    def assign(nearest: int):
        def run(frames):
            turn, middle = shared.value
            for frame in frames:
                for a in range(0, len(frame), 4096):
                    part = frame.iloc[a : a + 4096]
                    v = _matrix(part["v"]) @ turn
                    away = -2 * v @ middle.T + (middle**2).sum(axis=1)
                    order = np.argsort(away, axis=1, kind="stable")[:, :nearest]
                    yield pd.DataFrame({"id": part["id"], "lists": order.tolist(), "rotated": v.tolist()})

        return run

    schema = "id bigint, lists array<int>, rotated array<double>"
    content = cut(rows.mapInPandas(assign(1), schema).select("id", F.col("lists")[0].alias("list"), "rotated"))
    asking = rows if queries is None else tidy(queries).filter(F.size("v") == width)
    asking = asking.mapInPandas(assign(probed), schema).select(F.col("id").alias("query"), F.explode("lists").alias("list"), "rotated")
    parts = content.groupBy("list").agg(F.ceil(F.count("*") / PART_SIZE).alias("_parts"))
    content = content.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    asking = asking.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    # A list that many queries probe is scanned in several tasks as well.
    crowd = asking.groupBy("list").agg(F.ceil(F.count("*") / PROBES_PER_TASK).alias("_crowds"))
    asking = asking.join(crowd, "list").withColumn("crowd", F.pmod(F.xxhash64("query"), F.col("_crowds")))
    content = content.join(crowd, "list").withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_crowds") - 1)))
    by = ["list", "part", "crowd"]
    found = asking.select("query", "rotated", *by).groupBy(*by).cogroup(content.select("id", "rotated", *by).groupBy(*by)).applyInPandas(_scan_part(k), "query bigint, near bigint, d2 double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d2", "near"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "near", "rank", "d2")
