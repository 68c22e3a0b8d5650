"""Best representative of each duplicate group, chosen bundle by bundle.

A bundle is a set of fields that must come from one record.  Functional dependencies between bundles (``det -> dep``)
say that the chosen values must stand together in some record of the group.  The choice that maximises trust is
found by branch and bound: bundles are assigned in order, candidates best first, and a branch ends when what it has
plus the best that each open bundle could still add does not beat the incumbent.

The bound is computed before anything is gathered: one aggregation keeps, for each group and bundle, the best
record (the root's bound).  That aggregation combines on the map side and is safe for a group of any size.  A bundle without
dependencies attains its bound at the root, so its search needs nothing else and closes at the first leaf.  Bundles tied by dependencies go on:
their distinct value combinations, each with its best record, are shuffled by group and component, after those
combinations that can't beat the incumbent (the best single record that serves all bundles) are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWEST = -(1 << 62)


@dataclass(frozen=True)
class Bundle:
    """Fields that travel together, and when a record's values are fit for use."""

    name: str
    fields: tuple[str, ...]
    usable: Column = field(compare=False)


def normalised_members(ids: str) -> Column:
    """The set that an id list holds: lower case, trimmed, without nulls, blanks and repeats; null if empty."""
    trimmed = F.transform(F.col(ids), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    members = F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(members) > 0, members)


def _components(bundles: list[Bundle], dependencies: list[tuple[str, str]]) -> list[list[str]]:
    home = {b.name: {b.name} for b in bundles}
    for a, b in dependencies:
        merged = home[a] | home[b]
        for name in merged:
            home[name] = merged
    return [sorted(x, key=[b.name for b in bundles].index) for x in {frozenset(s) for s in home.values()}]


Score = tuple[int, int, int]


def branch_and_bound(
    order: list[str], candidates: dict[str, list[tuple[Score, str, int]]], together: dict[tuple[str, str], set[tuple[str, str]]]
) -> dict[str, tuple[Score, str, int]]:
    """The assignment of most bundles, and of these the one with the greatest summed score.

    ``candidates``: for each bundle (score, value, record), best first.  ``together``: for each dependency the value
    pairs that occur in one record.  Scores add up element by element and compare lexicographically.  A bundle without any candidate
    stays open, and so does one that no candidate fits once the dependencies can't all be met: a group with a candidate never ends empty.
    """
    best: dict[str, tuple[Score, str, int]] = {}
    best_score: tuple[int, ...] | None = None
    todo = [b for b in order if candidates.get(b)]
    add = lambda score, more: (score[0] + 1, *(x + y for x, y in zip(score[1:], more)))
    bound: list[tuple[int, ...]] = [(0, 0, 0, 0)]
    for b in reversed(todo):
        bound.append(add(bound[-1], candidates[b][0][0]))
    bound.reverse()

    def go(depth: int, chosen: dict[str, tuple[Score, str, int]], score: tuple[int, ...]) -> None:
        nonlocal best, best_score
        if best_score is not None and tuple(x + y for x, y in zip(score, bound[depth])) <= best_score:
            return
        if depth == len(todo):
            best, best_score = dict(chosen), score
            return
        name = todo[depth]
        for candidate in candidates[name]:
            reached = add(score, candidate[0])
            if best_score is not None and tuple(x + y for x, y in zip(reached, bound[depth + 1])) <= best_score:
                break  # candidates come best first: none of the rest can do better
            fits = all(
                (chosen[other][1], candidate[1]) in together[pair] if pair[1] == name else (candidate[1], chosen[other][1]) in together[pair]
                for pair in together
                if name in pair and (other := pair[0] if pair[1] == name else pair[1]) in chosen
            )
            if fits:
                chosen[name] = candidate
                go(depth + 1, chosen, reached)
                del chosen[name]
        go(depth + 1, chosen, score)  # the bundle stays open

    go(0, {}, (0, 0, 0, 0))
    return best


def best_representatives(
    df: DataFrame,
    key: str,
    record: str,
    bundles: list[Bundle],
    trust: Column,
    recency: Column,
    dependencies: list[tuple[str, str]] | None = None,
    least: int = 2,
) -> DataFrame:
    """One row per group of at least ``least`` records and bundle: (first_record, bundle, record).

    The order of records within a bundle is: higher ``trust`` (null lowest), later ``recency`` (timestamp, null
    earliest), smaller record id; ties are thus impossible, since ids are unique.  Rows with a null key belong to no
    group; repeated rows count as records.  A bundle without a usable record yields no row.  An empty table yields none.
    A dependency (det, dep) demands that the two chosen values occur together in a record usable for both.  If dependencies can't all be
    met, as many bundles as can are chosen, and of these choices the one of most trust; a bundle left open yields no row.
    """
    dependencies = dependencies or []
    names = [b.name for b in bundles]
    score = F.struct(
        F.coalesce(trust.cast("bigint"), F.lit(_LOWEST)).alias("t"),
        F.coalesce(F.unix_micros(recency.cast("timestamp")), F.lit(_LOWEST)).alias("r"),
        (-F.col(record)).alias("i"),
    )
    rows = df.select(
        F.col(key).alias("_key"),
        F.col(record).alias("_id"),
        score.alias("_score"),
        *[b.usable.alias(f"_u{i}") for i, b in enumerate(bundles)],
        *[F.to_json(F.struct(*b.fields)).alias(f"_v{i}") for i, b in enumerate(bundles) if dependencies],
    ).filter(F.col("_key").isNotNull())
    roots = (
        rows.groupBy("_key")
        .agg(
            F.count("*").alias("_n"),
            F.min("_id").alias("first_record"),
            *[F.max(F.when(F.col(f"_u{i}"), F.col("_score"))).alias(f"_b{i}") for i in range(len(bundles))],
        )
        .filter(F.col("_n") >= least)
    )
    tied = {n for c in _components(bundles, dependencies) if len(c) > 1 for n in c}
    free = [i for i, n in enumerate(names) if n not in tied]
    found = _free(roots, [names[i] for i in free], free) if free else None
    for component in _components(bundles, dependencies):
        if len(component) > 1:
            part = _tied(rows, roots, names, component, [d for d in dependencies if d[0] in component])
            found = part if found is None else found.unionByName(part)
    return found


def _free(roots: DataFrame, names: list[str], at: list[int]) -> DataFrame:
    """Branch and bound over bundles without dependencies: their root bounds are attained, so each search closes at its first leaf."""
    columns = [F.col(f"_b{i}.{part}").cast("string").alias(f"{part}{j}") for j, i in enumerate(at) for part in "tri"]  # text keeps all digits beside nulls

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            groups, names_out, records = [], [], []
            scores = [list(zip(*(frame[f"{part}{j}"].tolist() for part in "tri"))) for j, _ in enumerate(names)]
            for k, first in enumerate(frame["first_record"].tolist()):
                whole = {n: tuple(map(int, scores[j][k])) for j, n in enumerate(names) if isinstance(scores[j][k][2], str)}
                candidates = {n: [(score, "", -score[2])] for n, score in whole.items()}
                for n, (_, _, rec) in branch_and_bound(names, candidates, {}).items():
                    groups.append(first)
                    names_out.append(n)
                    records.append(rec)
            yield pd.DataFrame({"first_record": groups, "bundle": names_out, "record": records})

    return roots.select("first_record", *columns).mapInPandas(solve, "first_record bigint, bundle string, record bigint")


def _tied(rows: DataFrame, roots: DataFrame, names: list[str], component: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Branch and bound over the bundles of one component of the dependency graph."""
    at = [names.index(n) for n in component]
    usable = [F.col(f"_u{i}") for i in at]
    value = [f"v{j}" for j in range(len(at))]
    values = [F.when(F.coalesce(F.col(f"_u{i}"), F.lit(False)), F.col(f"_v{i}")).alias(v) for v, i in zip(value, at)]
    some = usable[0]
    for u in usable[1:]:
        some = some | u
    combos = rows.filter(some).groupBy("_key", *values).agg(F.max("_score").alias("_score"))
    for j, v in enumerate(value):  # a value may stand in several combinations; what it is worth is its best record's score
        worth = combos.filter(F.col(v).isNotNull()).groupBy("_key", v).agg(F.max("_score").alias(f"_s{j}"))
        combos = combos.join(worth, ["_key", v], "left")
    whole = usable[0]
    for u in usable[1:]:
        whole = whole & u
    incumbents = rows.filter(whole).groupBy("_key").agg(F.max("_score").alias("_inc"))
    kept = roots.select("_key", "first_record", *[F.col(f"_b{i}").alias(f"_b{j}") for j, i in enumerate(at)])
    joined = combos.join(kept, "_key").join(incumbents, "_key", "left")
    # A value can only be chosen if its score and the best scores of the other bundles together reach the incumbent's.
    parts = ("t", "r", "i")
    wide = lambda c: F.coalesce(c.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    floor = F.struct(*[(wide(F.col(f"_inc.{p}")) * F.lit(len(at))).alias(p) for p in parts])

    def ceiling(j: int) -> Column:
        others = [k for k in range(len(at)) if k != j]
        return F.struct(*[sum((wide(F.col(f"_b{k}.{p}")) for k in others), wide(F.col(f"_s{j}.{p}"))).cast("decimal(38,0)").alias(p) for p in parts])

    floor = F.struct(*[floor[p].cast("decimal(38,0)").alias(p) for p in parts])
    reach = [F.col(v).isNotNull() & (ceiling(j) >= floor) for j, v in enumerate(value)]
    anyone = reach[0]
    for r in reach[1:]:
        anyone = anyone | r
    scores = [F.col(f"_s{j}.{p}").cast("string").alias(f"{p}{j}") for j in range(len(at)) for p in parts]  # text keeps all digits beside nulls
    kept_rows = joined.filter(F.col("_inc").isNull() | anyone).select("first_record", *value, *scores)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        candidates: dict[str, dict[str, tuple[Score, str, int]]] = {n: {} for n in component}
        together: dict[tuple[str, str], set[tuple[str, str]]] = {p: set() for p in pairs}
        for row in group.itertuples(index=False):
            stands = {n: getattr(row, f"v{j}") for j, n in enumerate(component)}
            for j, (n, v) in enumerate(stands.items()):
                if v is not None and v not in candidates[n]:
                    score = tuple(int(getattr(row, f"{p}{j}")) for p in parts)
                    candidates[n][v] = (score, v, -score[2])
            for a, b in pairs:
                if stands[a] is not None and stands[b] is not None:
                    together[a, b].add((stands[a], stands[b]))
        ordered = {n: sorted(c.values(), key=lambda x: x[0], reverse=True) for n, c in candidates.items()}
        best = branch_and_bound(component, ordered, together)
        return pd.DataFrame({"first_record": group["first_record"].iloc[0], "bundle": list(best), "record": [b[2] for b in best.values()]})

    return kept_rows.groupBy("first_record").applyInPandas(solve, "first_record bigint, bundle string, record bigint")


def _finite(name: str) -> Column:
    return F.coalesce(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) != float("inf")), F.lit(False))


def aggregate_survivors(records: DataFrame, runs: DataFrame, dependencies: list[tuple[str, str]] | None = None, bundles: list[Bundle] | None = None) -> DataFrame:
    """Survivors of ``group_aggregates``: (first_rec_id, field_name, rec_id); each field a bundle of its own by default.

    ``runs`` is reduced to one trust per run and joined; a null or unknown run has the lowest trust.
    """
    trust = runs.filter(F.col("run_id").isNotNull()).groupBy(F.col("run_id").alias("_run")).agg(F.max("trust_level").alias("_trust"))
    bundles = bundles or [
        Bundle("start_sum", ("start_sum",), _finite("start_sum")),
        Bundle("svlen_sum", ("svlen_sum",), _finite("svlen_sum")),
        Bundle("support_calls", ("support_calls",), F.coalesce(F.col("support_calls") >= 1, F.lit(False))),
    ]
    keyed = records.withColumn("_members", normalised_members("id_list")).join(trust, F.col("run_id") == F.col("_run"), "left")
    best = best_representatives(keyed, "_members", "rec_id", bundles, F.col("_trust"), F.col("emitted_at"), dependencies)
    return best.select(F.col("first_record").alias("first_rec_id"), F.col("bundle").alias("field_name"), F.col("record").alias("rec_id"))
