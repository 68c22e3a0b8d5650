import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.config import EPSILON, MergeConfig
from callweave.functions import masks
from callweave.operators import aggregate as agg
from callweave.operators import intervals
from callweave.operators.cluster import Forest, agglomerate, cluster_calls, components
from callweave.operators.intervals import interval_join, repeat_of_deletions, repeat_of_insertions
from callweave.operators.pairs import candidate_pairs
from callweave.operators.shards import independent_shards

SCHEMA = (
    "idx long, block string, contig string, bucket string, svtype string, id string, sample_id int, start double, end double, svlen double, start_mean double, start_variance double, "
    "svlen_mean double, svlen_variance double, support_mask long, support_calls long, max_dist double, info_hash int, id_list array<string>, trid string, svclaim string, "
    "interval_start double, interval_end double, sequence string, motif_len int"
)


def call(idx, start, end, sample, r=8.0, trid=None, kind="DEL", svlen=None, claim=None, weight=1, block="b"):
    length = float(end if svlen is None else svlen)
    name = f"{sample}_{idx}"
    return (idx, block, "chr1", kind, kind, name, sample, float(start), float(end), length, start + 1.0, 0.0, length, 0.0, 1 << sample, weight, float(r), 0, [name], trid, claim, None, None, None, 0)


def groups(spark, rows, cfg):
    found = cluster_calls(spark.createDataFrame(rows, SCHEMA), cfg).collect()
    out = {}
    for r in found:
        out.setdefault((r["block"], r["group_id"]), set()).add(r["idx"])
    return sorted(map(sorted, out.values()))


CHAIN = [call(0, 0, 0, 0), call(1, 5, 5, 1), call(2, 10, 10, 2)]


@pytest.mark.parametrize("constraint,count", [("none", 1), ("bbox_diameter", 2), ("clique", 2), ("centroid", 1)])
def test_chain(spark, constraint, count):
    assert len(groups(spark, CHAIN, MergeConfig(merge_constraint=constraint))) == count


@pytest.mark.parametrize("constraint,count", [("none", 1), ("centroid", 2)])
def test_outlier(spark, constraint, count):
    rows = [call(0, 0, 0, 0, 2), call(1, 1, 1, 1, 20), call(2, 9, 9, 2, 20)]
    assert len(groups(spark, rows, MergeConfig(merge_constraint=constraint))) == count


def test_repeat_radius_size_and_samples(spark):
    assert len(groups(spark, [call(0, 0, 0, 0, 100, "t"), call(1, 2000, 0, 1, 100, "t")], MergeConfig())) == 1
    assert len(groups(spark, [call(0, 0, 0, 0, 100, "t"), call(1, 5, 0, 1, 100, "u")], MergeConfig())) == 2
    assert len(groups(spark, [call(0, 1000, 10, 0, 1000), call(1, 1000, 100, 1, 1000)], MergeConfig(min_size_similarity=0.7))) == 2
    same = [call(0, 0, 0, 0), call(1, 0, 0, 0)]
    assert len(groups(spark, same, MergeConfig())) == 2
    assert len(groups(spark, same, MergeConfig(allow_intrasample=True))) == 1
    far = [call(0, 0, 0, 0, 2), call(1, 5, 0, 1, 10)]
    assert len(groups(spark, far, MergeConfig())) == 2
    assert len(groups(spark, far, MergeConfig(no_mutual_distance=True))) == 1
    assert groups(spark, [], MergeConfig()) == []


def test_shards(spark):
    rows = [call(i, s, 0, i, 10) for i, s in enumerate((0, 3, 100, 105, 1000, 1015))]
    got = independent_shards(spark.createDataFrame(rows, SCHEMA), MergeConfig()).orderBy("idx").collect()
    assert [r["shard"] for r in got] == [0, 0, 1, 1, 2, 2]
    repeat = [call(0, 0, 0, 0, 10, "t"), call(1, 1500, 0, 1, 10, "t"), call(2, 10000, 0, 2, 10)]
    got = independent_shards(spark.createDataFrame(repeat, SCHEMA), MergeConfig(tr_max_dist=2000)).orderBy("idx").collect()
    assert [r["shard"] for r in got] == [0, 0, 1]


def direct_pairs(rows, cfg):
    """All pairs by the rules, for small inputs."""
    out = []
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a[1] != b[1] or (a[19] and b[19] and a[19] != b[19]):
                continue
            d = ((a[7] - b[7]) ** 2 + (a[8] - b[8]) ** 2) ** 0.5
            pick = max if cfg.no_mutual_distance else min
            limit = cfg.tr_max_dist if a[19] and a[19] == b[19] else pick(a[16], b[16])
            reach = [max(x[16], cfg.tr_max_dist) if x[19] else x[16] for x in (a, b)]
            if d <= limit + EPSILON:
                out.append((i, j, d, d <= reach[0] + EPSILON, d <= reach[1] + EPSILON))
    return out


def plain_clusters(rows, pairs, cfg):
    """The rules told step by step: every call offers its nearest partner left; the best offer of all is taken next.  No heap, no forest."""
    names = sorted(range(len(rows)), key=lambda i: (rows[i][5].encode(), i))
    rank = {i: k for k, i in enumerate(names)}
    wishes = {i: [] for i in range(len(rows))}
    for a, b, d, a_asks, b_asks in pairs:
        if a_asks:
            wishes[a].append((d, b))
        if b_asks:
            wishes[b].append((d, a))
    wishes = {i: [(0.0, i), *sorted(w)] for i, w in wishes.items()}
    home = {i: frozenset([i]) for i in range(len(rows))}
    place = lambda i: (rows[i][7], rows[i][8])
    gap = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5

    def limit(i, j):
        if rows[i][19] and rows[i][19] == rows[j][19]:
            return cfg.tr_max_dist
        return (max if cfg.no_mutual_distance else min)(rows[i][16], rows[j][16])

    def good(i, j, union):
        if any(rows[x][14] & rows[y][14] for x in home[i] for y in home[j]):
            return False
        xs, ys = [place(k)[0] for k in union], [place(k)[1] for k in union]
        if cfg.merge_constraint == "bbox_diameter":
            return gap((min(xs), min(ys)), (max(xs), max(ys))) <= limit(i, j) + EPSILON
        if cfg.merge_constraint == "clique":
            return all(gap(place(x), place(y)) <= limit(x, y) + EPSILON and not (rows[x][19] and rows[y][19] and rows[x][19] != rows[y][19]) for x in home[i] for y in home[j])
        if cfg.merge_constraint == "centroid":
            middle = (sum(xs) / len(xs), sum(ys) / len(ys))
            return all(gap(place(k), middle) <= rows[k][16] + EPSILON for k in union)
        return True

    while any(wishes.values()):
        offers = [(round(w[0][0] * 1e9), 0, 0, rank[i], rank[w[0][1]], i, w[0][1]) for i, w in wishes.items() if w]
        *_, i, j = min(offers)
        wishes[i].pop(0)
        union = home[i] | home[j]
        if home[i] != home[j] and good(i, j, union):
            for k in union:
                home[k] = union
    return sorted({tuple(sorted(c)) for c in home.values()})


@pytest.mark.parametrize("constraint", ["none", "bbox_diameter", "clique", "centroid"])
def test_clusters_equal_plain_model(spark, constraint):
    rng = random.Random(len(constraint))
    for no_mutual in (False, True):
        cfg = MergeConfig(merge_constraint=constraint, no_mutual_distance=no_mutual, tr_max_dist=30)
        rows = [
            call(i, rng.randrange(0, 400), rng.randrange(0, 6), rng.randrange(6), rng.choice([2, 5, 9, 33]), rng.choice([None, None, "t", "u"])) for i in range(120)
        ]
        pairs = direct_pairs(rows, cfg)
        got = candidate_pairs(spark.createDataFrame(rows, SCHEMA), cfg).collect()
        assert sorted((r["a"], r["b"]) for r in got) == sorted((p[0], p[1]) for p in pairs)
        assert groups(spark, rows, cfg) == [list(c) for c in plain_clusters(rows, pairs, cfg)]


def test_near_ties_go_by_order():
    """Distances a billionth apart are ties: the smaller hash comes first although its offer is farther."""
    calls = [{"start": 0.0, "end": 0.0, "max_dist": 9.0, "mask": m, "hash": h, "rank": k, "trid": None} for k, (m, h) in enumerate([(1, 5), (2, 1), (2, 1)])]
    pairs = [(0, 1, 3.0 + 0.9e-9, False, True), (0, 2, 3.0, True, False)]
    assert agglomerate(calls, pairs, MergeConfig()) == [0, 0, 2]
    assert agglomerate(calls, [(0, 1, 3.0 + 5e-9, False, True), (0, 2, 3.0, True, False)], MergeConfig()) == [0, 1, 0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5)), min_size=1, max_size=30))
def test_open_clusters_are_components(points):
    rows = [call(i, x, y, 0, 4) for i, (x, y) in enumerate(points)]
    cfg = MergeConfig(allow_intrasample=True)
    pairs = direct_pairs(rows, cfg)
    label = list(range(len(rows)))
    for _ in rows:
        for a, b, *_ in pairs:
            label[a] = label[b] = min(label[a], label[b])
    model = [{"start": r[7], "end": r[8], "max_dist": r[16], "mask": 1, "hash": 0, "rank": i, "trid": None} for i, r in enumerate(rows)]
    assert agglomerate(model, pairs, cfg) == label


def test_forest_masks():
    forest = Forest([(0, 0), (1, 1), (2, 2)], [1, 2, 1 << 63], True)
    forest.union(0, 1)
    assert forest.find(0) == forest.find(1) == 1
    assert forest.mask[1] == 3 and forest.box[1] == (0, 1, 0, 1)
    assert forest.allowed(1, 2) and not Forest([(0, 0)] * 2, [4, 4], True).allowed(0, 1)


def test_components_of_a_path(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    edges = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = {r["node"]: r["component"] for r in components(nodes, edges).collect()}
    assert got == {i: 0 if i < 40 else i for i in range(60)}


@pytest.mark.parametrize("relation", ["overlapping", "contained", "containing"])
def test_interval_join_equals_naive(spark, relation):
    rng = random.Random(11)
    spans = [(i, "c", a, a + rng.choice([0, 3, 50, 4000])) for i, a in enumerate(rng.choices(range(5000), k=80))]
    asks = [(i, rng.choice(["c", "d", None]), a, a + rng.choice([0, 10, 900])) for i, a in enumerate(rng.choices(range(5000), k=60))]
    q = spark.createDataFrame(asks, "q long, contig string, q_start long, q_end long")
    t = spark.createDataFrame([(i, c, e, s) if i % 9 == 0 else (i, c, s, e) for i, c, s, e in spans], "t long, contig string, start long, stop long")
    test = {"overlapping": lambda qs, qe, s, e: e >= qs and s <= qe, "contained": lambda qs, qe, s, e: s >= qs and e <= qe, "containing": lambda qs, qe, s, e: s <= qs and e >= qe}[relation]
    want = sorted((i, j) for i, c, qs, qe in asks for j, d, s, e in spans if c == d and test(qs, qe, s, e))
    assert sorted((r["q"], r["t"]) for r in interval_join(q, t, relation).collect()) == want


def test_repeat_containment(spark):
    t = spark.createDataFrame([("c", 100, 200, "outer", 2), ("c", 130, 160, "inner", 2), ("d", 100, 150, "left", 3), ("d", 150, 200, "right", 3)], "contig string, start long, stop long, tr_id string, motif_len int")
    dels = spark.createDataFrame([(1, "c", 140, 150), (2, "d", 120, 180), (3, "c", 99, 151)], "idx long, contig string, del_start long, del_end long")
    got = {r["idx"]: r["tr_id"] for r in repeat_of_deletions(dels, t, 0, 600_000, 1).collect()}
    assert got == {1: "inner", 3: "outer"}
    ins = spark.createDataFrame([(1, "c", 99), (2, "c", 202), (3, "c", 204), (4, "c", 150)], "idx long, contig string, pos long")
    got = {r["idx"]: r["tr_id"] for r in repeat_of_insertions(ins, t, 2).collect()}
    assert got == {1: "outer", 2: "outer", 4: "inner"}


def best_by_pairs(dels, repeats, slop, share, least):
    """{idx: tr_id} of repeat_of_deletions, from all pairs."""
    found = {}
    for idx, contig, first, last in dels:
        a, b, n, seen = max(first - slop, 0), last + slop, last - first, []
        for c, x, y, tr_id, _ in repeats:
            s, e = min(x, y), max(x, y)
            o = max(0, min(b, e) - max(a, s))
            if c == contig and contig and o >= least and o * 1_000_000 >= share * n:
                seen.append((-(2_000_000 * o // (n + e - s)), -o, e - s, s, tr_id))
        if seen:
            found[idx] = min(seen)[-1]
    return found


REPEATS = "contig string, start long, stop long, tr_id string, motif_len int"


@pytest.mark.parametrize("bin_rows, group_rows, slop, share", [(250_000, 20_000, 0, 800_000), (15, 40, 3, 100_000)])
def test_best_repeat_equals_all_pairs(spark, monkeypatch, bin_rows, group_rows, slop, share):
    monkeypatch.setattr(intervals, "_BIN_ROWS", bin_rows)
    monkeypatch.setattr(intervals, "_GROUP_ROWS", group_rows)
    rng = random.Random(5)
    places = [*range(3000), *range(3000, 200_000, 91)]
    dels = [(i, rng.choice(["c", "d", None]), a, a + rng.choice([0, 1, 30, 60, 900, 70_000])) for i, a in enumerate(rng.choices(places, k=300))]
    ends = [(a, a + rng.choice([0, 20, 40, 50, 900, 60_000, 9_000_000])) for a in rng.choices(places, k=250)]
    repeats = [(rng.choice(["c", "d", None]), *(x if i % 5 else x[::-1]), f"T{rng.randrange(900)}", None) for i, x in enumerate(ends)]
    repeats += [(c, s, e, "S" + t, 2) for c, s, e, t, _ in repeats[:80]]
    q, t = spark.createDataFrame(dels, "idx long, contig string, del_start long, del_end long"), spark.createDataFrame(repeats, REPEATS)
    got = {r["idx"]: r["tr_id"] for r in repeat_of_deletions(q, t, slop, share, 1).collect()}
    assert len(got) > 50 and got == best_by_pairs(dels, repeats, slop, share, 1)


def most_rows(node):
    """The most rows that a step of a plan gave."""
    kind = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
    below = node.children()
    inner += [below.apply(i) for i in range(below.size())]
    rows = node.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(most_rows, inner)])


def test_best_repeat_lists_no_pairs(spark):
    dels = [(i, "c", 5000 + i % 40, 5200 + i % 37) for i in range(1500)]
    repeats = [("c", 5000 - i % 50, 5240 + i % 11, f"T{i}", 2) for i in range(1500)]
    best = repeat_of_deletions(spark.createDataFrame(dels, "idx long, contig string, del_start long, del_end long"), spark.createDataFrame(repeats, REPEATS), 0, 800_000, 1)
    assert {r["idx"]: r["tr_id"] for r in best.collect()} == best_by_pairs(dels, repeats, 0, 800_000, 1)
    assert most_rows(best._jdf.queryExecution().executedPlan()) <= 3 * (len(dels) + len(repeats))


def merged(spark, rows, cfg=None):
    members = spark.createDataFrame(rows, SCHEMA).withColumn("group_id", F.lit(0).cast("long"))
    return agg.merged_records(members, cfg or MergeConfig()).first()


def test_moments_and_intervals(spark):
    r = merged(spark, [call(0, 0, 1, 0, svlen=-1), call(1, 1, 2, 1, svlen=-2), call(2, 2, 3, 2, svlen=-3)])
    assert (r["pos"], r["svlen"], r["cipos"], r["ciend"], r["end"]) == (1, -2, [-1, 3], [-1, 3], 3)
    r = merged(spark, [call(0, 0, 10, 0, svlen=-10), call(1, 0, 20, 1, svlen=-20), call(2, 0, 30, 2, svlen=-30)])
    assert (r["svlen"], r["cipos"], r["ciend"]) == (-20, [0, 0], [-16, 16])


def test_claims_support_and_filter(spark):
    r = merged(spark, [call(0, 0, 1, 0, claim="D", weight=2), call(1, 0, 1, 1, claim="D", weight=3)])
    assert (r["svclaim"], r["svclaim_set"], r["supp"], r["supp_calls"], r["idlist"]) == ("D", None, 2, 5, ["0_0", "1_1"])
    r = merged(spark, [call(0, 0, 1, 0, claim="D"), call(1, 0, 1, 1)])
    assert (r["svclaim"], r["svclaim_set"]) == (None, ["D"])
    assert merged(spark, [call(0, 0, 1, 0)], MergeConfig(min_supp=2)) is None
    assert merged(spark, [call(0, 0, 1, 0, kind="INS")])["end"] is None


def test_variance_is_stable(spark):
    rows = [call(i, 29660534, 1, i) for i in range(28)]
    members = spark.createDataFrame(rows, SCHEMA).withColumn("group_id", F.lit(0)).withColumn("start_variance", F.lit(0.01))
    assert abs(agg.moments(members).first()["var_start"] - 0.01) < 1e-12


def test_masks_of_any_width(spark):
    words = [([1],), ([6],), ([-(1 << 63)],), ([0],), ([-1],), ([0, 4, 0],)]
    got = spark.createDataFrame(words, "m array<long>").select(masks.first(F.col("m")), masks.samples_of(F.col("m"))).collect()
    assert [r[0] for r in got] == [0, 1, 63, masks._NONE, 0, 66]
    assert got[1][1] == [1, 2] and got[4][1] == list(range(64)) and got[5][1] == [66]
    rows = spark.createDataFrame([([0, 63, 64, 129],), ([None, 64],), ([],)], "s array<int>").select("s", masks.of_samples(F.col("s"), 3).alias("m"))
    assert [r[1] for r in rows.collect()] == [[-(1 << 63) + 1, 1, 2], [0, 1, 0], [0, 0, 0]]
    assert rows.agg(masks.union_size("m", 3)).first()[0] == 4
    assert [r[0] for r in rows.select(masks.holds(F.col("m"), F.lit(64))).collect()] == [True, True, False]
    assert [r[0] for r in rows.select(masks.shared(F.col("m"), F.array(*[F.lit(x).cast("bigint") for x in (0, 1)]))).collect()] == [True, True, False]
    with pytest.raises(Exception, match="beyond"):
        rows.select(masks.of_samples(F.col("s"), 1)).collect()


def test_many_samples(spark):
    """130 samples, each with a call of one place: the mask has three words, support counts all samples."""
    rows = [call(i, 100 + i % 3, 50, 0) for i in range(130)]
    wide = spark.createDataFrame(rows, SCHEMA).withColumn("sample_id", F.col("idx").cast("int")).withColumn("support_mask", masks.of_samples(F.array(F.col("idx").cast("int")), 3))
    members = wide.join(cluster_calls(wide, MergeConfig()), ["block", "idx"])
    record = agg.merged_records(members, MergeConfig(), 3).collect()
    assert [(r["supp"], r["supp_calls"]) for r in record] == [(130, 130)]
    twice = wide.withColumn("support_mask", masks.of_samples(F.array((F.col("idx") % 65).cast("int")), 3))
    found = cluster_calls(twice, MergeConfig()).groupBy("group_id").count().collect()
    assert sorted(r["count"] for r in found) == [43, 43, 44]  # one cluster a place: those of one sample never join


def test_settings_that_change_nothing(spark):
    base = groups(spark, CHAIN, MergeConfig())
    assert all(groups(spark, CHAIN, replace(MergeConfig(), **c)) == base for c in ({"knn_search_k": 1}, {"no_shard": True}, {"min_shard_size": 9}))
