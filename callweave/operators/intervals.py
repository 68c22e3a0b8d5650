"""Joins on ranges, planned as equi-joins on bins so that no side is ever compared whole with the other.

Both sides are binned at the power of two that covers their length, and at the coarser levels that the other side has; a pair meets
at the coarser of its two levels.  So a row has at most two bins for each level, however long it is, and the number of levels is bounded by the
position range (about 40).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from callweave.functions.scalars import distance_to_interval
from callweave.session import cut

_LEAST_LEVEL = 6
#: The search for best repeats has wider bins: levels from the least in steps; rows that a group has about, and those of one bin and side beyond which it is dealt out.
_SEARCH_LEVEL, _SEARCH_STEP, _GROUP_ROWS, _BIN_ROWS = 13, 3, 20_000, 250_000
#: Pairs that cost what one size for queries of like width does, as timed (a query for a size costs a tenth of a pair), and pairs held at once.
_PAIRS_A_STEP, _PAIRS_AT_ONCE = 300, 1_000_000


def _level(length: Column) -> Column:
    return F.greatest(F.lit(_LEAST_LEVEL), F.ceil(F.log2(F.greatest(length.cast("double"), F.lit(1.0))))).cast("int")


def _bin(position: Column, level: Column) -> Column:
    return F.floor(position / F.pow(F.lit(2.0), level)).cast("bigint")


_RELATIONS = {
    "overlapping": lambda qs, qe, s, e: (e >= qs) & (s <= qe),
    "contained": lambda qs, qe, s, e: (s >= qs) & (e <= qe),
    "containing": lambda qs, qe, s, e: (s <= qs) & (e >= qe),
}


def interval_join(queries: DataFrame, intervals: DataFrame, relation: str = "overlapping", key: str = "contig", pad: int = 0) -> DataFrame:
    """Pairs of a query (q_start, q_end) and an interval (start, stop) of one ``key`` in the given relation.

    Ends are closed, touching counts; reversed intervals are turned; ``pad`` widens the queries (near queries).  Rows with
    a null key or end have no partner.  Column names of the two sides other than ``key`` must differ.
    """
    q0 = F.least("q_start", "q_end") - pad
    q1 = F.greatest("q_start", "q_end") + pad
    right = intervals.withColumn("_s", F.least("start", "stop")).withColumn("_e", F.greatest("start", "stop"))
    right = right.withColumn("_own", _level(F.col("_e") - F.col("_s") + 1))
    left = queries.withColumn("_q0", q0).withColumn("_q1", q1).filter(F.col("_q0").isNotNull() & F.col("_q1").isNotNull())
    left = left.withColumn("_asked", _level(F.col("_q1") - F.col("_q0") + 1))

    def binned(df: DataFrame, own: str, low: str, high: str, other: DataFrame, other_level: str) -> DataFrame:
        """Rows at their own level and at the other side's coarser ones, in the bins of their two ends."""
        levels = other.groupBy(key).agg(F.collect_set(other_level).alias("_levels"))
        at = F.array_union(F.array(own), F.filter("_levels", lambda v: v > F.col(own)))
        rows = df.join(levels, key).withColumn("_level", F.explode(at)).drop("_levels")
        return rows.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(F.col(low), F.col("_level")), _bin(F.col(high), F.col("_level"))))))

    joined = binned(left, "_asked", "_q0", "_q1", right, "_own").join(binned(right, "_own", "_s", "_e", left, "_asked"), [key, "_level", "_bin"])
    # A pair meets at one level; in two bins of it, it counts in the first.
    joined = joined.filter(F.col("_level") == F.greatest("_asked", "_own"))
    first = F.greatest(_bin(F.col("_q0"), F.col("_level")), _bin(F.col("_s"), F.col("_level")))
    good = _RELATIONS[relation](F.col("_q0"), F.col("_q1"), F.col("_s"), F.col("_e"))
    return joined.filter((F.col("_bin") == first) & good).drop("_level", "_bin", "_q0", "_q1", "_s", "_e", "_asked", "_own")


def semi_interval(queries: DataFrame, intervals: DataFrame, ident: str, relation: str = "containing", key: str = "contig", anti: bool = False) -> DataFrame:
    """Queries with some (or, ``anti``, no) interval in the relation; ``ident`` identifies a query."""
    hit = interval_join(queries.select(ident, key, "q_start", "q_end"), intervals.select(key, "start", "stop"), relation, key).select(ident).distinct()
    return queries.join(hit, ident, "left_anti" if anti else "left_semi")


def _turned(repeats: DataFrame) -> DataFrame:
    """Repeats with their ends in order; a catalog may name the greater first."""
    ends = {"start": F.least("start", "stop"), "stop": F.greatest("start", "stop")}
    return repeats.select("contig", *[v.alias(k) for k, v in ends.items()], "tr_id", "motif_len")


def _best(pairs: DataFrame, ident: str, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    return pairs.withColumn("_r", rank).filter(F.col("_r") == 1).drop("_r")


def _search_level(length: Column) -> Column:
    over = F.greatest(F.log2(length.cast("double")) - _SEARCH_LEVEL, F.lit(0.0))
    return (_SEARCH_LEVEL + _SEARCH_STEP * F.ceil(over / _SEARCH_STEP)).cast("int")


def _shifted(x: Column, level: Column, by: str = "shiftright") -> Column:
    return F.call_function(by, x, level)


def _placed(df: DataFrame, low: Column, high: Column, own: list[int], other: list[int], asks: bool) -> DataFrame:
    """Rows from ``low`` to ``high`` of level _own at each _place (bin, level and who is of that level, in one number), given both sides' levels.

    A pair meets once, at the coarser of its two levels: among queries of that level, or else among repeats of it.  A query stands in the
    bin of its start, a repeat in all bins, at most three, where a query that reaches it may start.
    """
    at = F.array(F.col("_own") * 2)
    if coarser := [v for v in other if v > min(own)]:
        at = F.concat(at, F.transform(F.filter(F.array(*[F.lit(v) for v in coarser]), lambda v: v > F.col("_own")), lambda v: v * 2 + int(asks)))
    if not asks and max(own) > min(other):
        at = F.when(F.col("_own") > min(other), F.concat(at, F.array(F.col("_own") * 2 + 1))).otherwise(at)
    one = max(own + other) == min(own + other)
    df = df.withColumn("_at", F.col("_own") * 2 if one else F.explode(at)).withColumn("_level", _shifted(F.col("_at"), F.lit(1)))
    level = F.col("_level")
    bins = _shifted(low, level) if asks else F.explode(F.sequence(_shifted(low - _shifted(F.lit(1).cast("bigint"), level, "shiftleft") + 1, level), _shifted(high, level)))
    return df.withColumn("_bin", bins).withColumn("_place", F.col("_bin") * 128 + F.col("_at")).drop("_own", "_at", "_level", "_bin")


def _dealt(df: DataFrame, ident: Column, crowded: DataFrame | None, own: str, other: str, groups: int) -> DataFrame:
    """Rows with their group; in a crowded bin each part of one side meets each part of the other."""
    if crowded is None:
        df = df.withColumn("_cell", F.lit(0).cast("bigint"))
    else:
        mine, rest = (F.coalesce(F.col(c), F.lit(1).cast("bigint")) for c in (own, other))
        part, each = F.pmod(F.xxhash64(ident), mine), F.explode(F.sequence(F.lit(0).cast("bigint"), rest - 1))
        df = df.join(F.broadcast(crowded), ["contig", "_place"], "left").withColumn("_part", part).withColumn("_each", each)
        cell = F.col("_part") * rest + F.col("_each") if own == "_asks" else F.col("_each") * mine + F.col("_part")
        df = df.withColumn("_cell", cell).drop("_part", "_each", "_asks", "_repeats")
    return df.withColumn("_group", F.pmod(F.xxhash64("contig", "_place", "_cell"), F.lit(groups)).cast("int"))


def _dice(overlap: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.floor(2.0 * overlap * 1_000_000 / np.maximum(length + size, 1)).astype(np.int64)


def _better(new: tuple[np.ndarray, ...], old: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether (Dice, overlap, size) comes before another; repeats of one size are compared by their start earlier."""
    return (new[0] > old[0]) | ((new[0] == old[0]) & ((new[1] > old[1]) | ((new[1] == old[1]) & (new[2] < old[2]))))


def best_overlaps(a: np.ndarray, b: np.ndarray, length: np.ndarray, need: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the best repeat or -1, Dice, overlap) of each query a to b; repeats are sorted by size and start and differ.

    Where few repeats overlap, all that do are compared; else sizes are tried one by one.  Both give the same.
    """
    kind = np.floor(np.log2(size + 1.0)).astype(np.int64)
    spans = []  # repeats of like sizes by start, and which of them each query may meet
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        rows = rows[np.argsort(start[rows], kind="stable")]
        spans.append((rows, np.searchsorted(start[rows], a - size[rows].max()), np.searchsorted(start[rows], b, "right")))
    pairs = sum(int(np.maximum(hi - lo, 0).sum()) for _, lo, hi in spans)
    likes = 2 * np.log2(np.maximum(b - a, 1).max()) + 1
    few = pairs < len(np.unique(size)) * (_PAIRS_A_STEP * likes + len(a) / 10)
    return (_best_by_pairs if few else _best_by_size)(a, b, length, need, start, size, spans)


def _best_by_pairs(a: np.ndarray, b: np.ndarray, length: np.ndarray, need: np.ndarray, start: np.ndarray, size: np.ndarray, spans: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    score, shared, row, best_size = np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
    for rows, lo, hi in spans:
        some = np.flatnonzero(hi > lo)
        count = (hi - lo)[some]
        parts = np.flatnonzero(np.diff(np.cumsum(count) // _PAIRS_AT_ONCE)) + 1
        for mine in np.split(some, parts):
            n = (hi - lo)[mine]
            q = np.repeat(mine, n)
            c = rows[np.repeat(lo[mine] - np.cumsum(n) + n, n) + np.arange(len(q))]
            o = np.minimum(b[q], start[c] + size[c]) - np.maximum(a[q], start[c])
            fit = o >= np.maximum(need[q], 0)
            q, c, o = q[fit], c[fit], o[fit]
            d = _dice(o, length[q], size[c])
            order = np.lexsort((start[c], size[c], -o, -d, q))
            first = order[np.append(True, np.diff(q[order]) != 0)] if len(order) else order
            q, c, o, d = q[first], c[first], o[first], d[first]
            won = _better((d, o, size[c]), (score[q], shared[q], best_size[q]))
            q, c = q[won], c[won]
            score[q], shared[q], best_size[q], row[q] = d[won], o[won], size[c], c
    return row, score, shared


def _best_by_size(a: np.ndarray, b: np.ndarray, length: np.ndarray, need: np.ndarray, start: np.ndarray, size: np.ndarray, _: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the repeats of one size, the overlap grows with the start up to a plateau and falls after it: the first on or after the
    plateau's begin or the one before is best.  Sizes are tried from the most promising on, for queries that they may still improve.
    """
    score, shared, row = np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64)
    sizes, begins = np.unique(size, return_index=True)
    ends, width = np.append(begins[1:], len(size)), b - a
    able = np.flatnonzero((width >= need) & (need <= sizes[-1]) & (width >= 0))
    able = able[np.argsort(width[able], kind="stable")]
    kind = np.floor(2 * np.log2(width[able] + 1.0))
    for chunk in np.split(able, np.flatnonzero(np.diff(kind)) + 1):
        if not len(chunk):
            continue
        qa, qb, w, n, least = a[chunk], b[chunk], width[chunk], length[chunk], need[chunk]
        best, best_o, best_size, best_row = score[chunk], shared[chunk], np.zeros(len(chunk), np.int64), row[chunk]
        fit = np.flatnonzero(sizes >= least.min())
        most = _dice(np.minimum(sizes[fit], w.max()), n.min(), sizes[fit])
        for k in np.argsort(-most, kind="stable"):
            if most[k] < best.min():
                break
            t, (lo, hi) = sizes[fit[k]], (begins[fit[k]], ends[fit[k]])
            top = np.minimum(w, t)
            live = np.flatnonzero((top >= least) & (_dice(top, n, t) >= best))
            if not len(live):
                continue
            la, lb = qa[live], qb[live]
            own = start[lo:hi]
            after = np.searchsorted(own, np.minimum(la, lb - t))
            before, after = np.maximum(after - 1, 0), np.minimum(after, hi - lo - 1)
            o0, o1 = (np.minimum(lb, own[i] + t) - np.maximum(la, own[i]) for i in (before, after))
            o, at = np.where(o1 > o0, o1, o0), np.where(o1 > o0, after, before)
            got = _dice(o, n[live], t)
            better = _better((got, o, t), (best[live], best_o[live], best_size[live])) & (o >= np.maximum(least[live], 0))
            won = live[better]
            best[won], best_o[won], best_size[won], best_row[won] = got[better], o[better], t, at[better] + lo
        score[chunk], shared[chunk], row[chunk] = best, best_o, best_row
    return row, score, shared


def _best_of_group(least_share: int, least_overlap: int, schema: pa.Schema) -> Callable:
    def run(asks: pa.Table, repeats: pa.Table) -> pa.Table:
        if not asks.num_rows or not repeats.num_rows:
            return schema.empty_table()
        both = lambda c: pa.chunked_array([*asks[c].chunks, *repeats[c].chunks]).combine_chunks()
        place = both("contig").dictionary_encode().indices.to_numpy().astype(np.int64)
        for c in ("_place", "_cell"):
            own = np.unique(both(c).to_numpy(), return_inverse=True)[1]
            place = np.unique(place * (own.max() + 1) + own, return_inverse=True)[1]
        here, there = place[: asks.num_rows], place[asks.num_rows :]
        a, b, length = (asks[c].to_numpy() for c in ("q_start", "q_end", "_length"))
        s, e = repeats["start"].to_numpy(), repeats["stop"].to_numpy()
        # Places are laid side by side, so that one search serves all.
        low, high = np.full(place.max() + 1, np.iinfo(np.int64).max), np.full(place.max() + 1, np.iinfo(np.int64).min)
        for at, x, y in ((here, a, b), (there, s, e)):
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, y)
        if len(low) > 1 and (high.astype(float) - low).sum() > 2.0**61:
            return pa.concat_tables([run(asks.filter(pa.array(here == p)), repeats.filter(pa.array(there == p))) for p in range(len(low))])
        wide = high - low + 1
        shift = np.cumsum(wide) - wide - low if len(low) > 1 else np.zeros(1, np.int64)
        keys = {"size": e - s, "start": s + shift[there], "tr_id": repeats["tr_id"]}
        order = pc.sort_indices(pa.table(keys), sort_keys=[(c, "ascending") for c in keys], null_placement="at_start").to_numpy()
        size, start = keys["size"][order], keys["start"][order]
        new = np.append(True, (np.diff(size) != 0) | (np.diff(start) != 0))  # of copies, the first id
        whole, rest = np.divmod(length, 1_000_000)
        need = np.maximum(least_share * whole - (-least_share * rest // 1_000_000), least_overlap)
        row, score, shared = best_overlaps(a + shift[here], b + shift[here], length, need, start[new], size[new])
        found = np.flatnonzero(row >= 0)
        chosen = repeats.take(pa.array(order[new][row[found]]))
        columns = [asks["idx"].take(pa.array(found)), score[found], shared[found], size[new][row[found]], chosen["start"], chosen["tr_id"], chosen["motif_len"]]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=schema.names).cast(schema)

    return run


def repeat_of_deletions(calls: DataFrame, repeats: DataFrame, slop: int, least_share: int, least_overlap: int) -> DataFrame:
    """The best repeat of each deletion (idx, contig, del_start, del_end): (idx, tr_id, motif_len).

    The overlap, widened by ``slop`` for the search, needs ``least_overlap`` bases and ``least_share`` millionths of the deletion;
    best are the greatest Dice coefficient, overlap, then the shorter and earlier repeat, then the smaller id.  Deletions that end before
    they begin have none.  No pairs are listed: each bin's repeats are searched, and a query leaves with one.
    """
    length = (F.col("del_end") - F.col("del_start")).cast("bigint").alias("_length")
    start, stop = F.greatest(F.col("del_start") - slop, F.lit(0)).cast("bigint").alias("q_start"), (F.col("del_end") + slop).cast("bigint").alias("q_end")
    asks = calls.select("idx", "contig", start, stop, length).filter("contig IS NOT NULL AND _length >= 0 AND q_end >= q_start")
    held = _turned(repeats).filter("contig IS NOT NULL AND start IS NOT NULL").withColumns({c: F.col(c).cast("bigint") for c in ("start", "stop")})
    asks = asks.withColumn("_own", _search_level(F.col("q_end") - F.col("q_start") + 1))
    held = held.withColumn("_own", _search_level(F.col("stop") - F.col("start") + 1))
    # Rows by bin, to know the levels, how many groups there should be, and what is crowded.
    counted = lambda df, x, asked: df.groupBy("contig", "_own", _shifted(F.col(x), F.col("_own")).alias("_from"), F.lit(asked).alias("_asked")).agg(F.count("*").alias("_n"))
    counts = cut(counted(asks, "q_start", True).unionByName(counted(held, "start", False)))
    levels = {x["_asked"]: sorted(x["levels"]) for x in counts.groupBy("_asked").agg(F.collect_set("_own").alias("levels")).collect()}
    mine, theirs = levels.get(True, [_SEARCH_LEVEL]), levels.get(False, [_SEARCH_LEVEL])
    ends = [_shifted(F.col("_from") + n, F.col("_own"), "shiftleft") - n for n in (0, 1)]
    n, m = F.when(F.col("_asked"), F.col("_n")), F.when(~F.col("_asked"), F.col("_n"))
    rough = _placed(counts.filter("_asked"), *ends, mine, theirs, True).unionByName(_placed(counts.filter("NOT _asked"), *ends, theirs, mine, False))
    by_place = rough.groupBy("contig", "_place").agg(F.sum(n).alias("_n"), F.sum(m).alias("_m")).filter("_n > 0 AND _m > 0")
    parts = F.struct("contig", "_place", *[F.ceil(F.col(c) / _BIN_ROWS).alias(n) for c, n in (("_n", "_asks"), ("_m", "_repeats"))])
    total = by_place.agg(F.sum(F.col("_n") + F.col("_m")).alias("rows"), F.collect_list(F.when((F.col("_n") > _BIN_ROWS) | (F.col("_m") > _BIN_ROWS), parts)).alias("crowded")).first()
    groups = max(1, -(-(total["rows"] or 0) // _GROUP_ROWS))
    spark = calls.sparkSession
    crowded = spark.createDataFrame(total["crowded"], "contig string, _place bigint, _asks bigint, _repeats bigint") if total["crowded"] else None
    asks = _placed(asks, F.col("q_start"), F.col("q_end"), mine, theirs, True)
    held = _placed(held, F.col("start"), F.col("stop"), theirs, mine, False)
    asks, held = _dealt(asks, F.col("idx"), crowded, "_asks", "_repeats", groups), _dealt(held, F.col("tr_id"), crowded, "_repeats", "_asks", groups)
    numbers = [StructField(c, LongType()) for c in ("_score", "_o", "_size")]
    schema = StructType([asks.schema["idx"], *numbers, *[held.schema[c] for c in ("start", "tr_id", "motif_len")]])
    search = _best_of_group(least_share, least_overlap, to_arrow_schema(schema))
    found = asks.groupBy("_group").cogroup(held.groupBy("_group")).applyInArrow(search, schema)
    order = [F.col("_score").desc(), F.col("_o").desc(), F.col("_size").asc(), F.col("start").asc(), F.col("tr_id").asc()]
    return _best(found, "idx", order).select("idx", "tr_id", "motif_len")


def repeat_of_insertions(calls: DataFrame, repeats: DataFrame, most: int) -> DataFrame:
    """The best repeat of each insertion (idx, contig, pos): within ``most`` of a closed repeat, seen from pos and pos - 1.

    Best are repeats that hold the position, then the nearest, the shorter, the earlier, the smaller id.
    """
    queries = calls.withColumn("q_start", F.col("pos") - 1).withColumn("q_end", F.col("pos"))
    pairs = interval_join(queries, _turned(repeats), pad=most + 1)
    at = lambda p: distance_to_interval(p, F.col("start"), F.col("stop"))
    gap = F.least(at(F.col("pos")), at(F.col("pos") - 1))
    inside = ((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("stop"))) | ((F.col("pos") - 1 >= F.col("start")) & (F.col("pos") - 1 <= F.col("stop")))
    pairs = pairs.withColumn("_d", gap).filter(F.col("_d") <= most)
    order = [inside.desc(), F.col("_d").asc(), (F.col("stop") - F.col("start")).asc(), F.col("start").asc(), F.col("tr_id").asc()]
    return _best(pairs, "idx", order).select("idx", "tr_id", "motif_len")
