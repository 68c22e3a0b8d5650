import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.operators.heavy import heavy_keys, per_key_distinct
from callweave.operators.ingest import load_catalog, parse_catalog_lines
from callweave.operators.prefix import prefix_scan
from callweave.operators import references
from callweave.operators.references import broken_references

GOOD = "chr1\t10\t20\tID=a;MOTIFS=AC,G"
CASES = [
    (GOOD, None),
    ("  chr1  10\t\r20   ID=a;MOTIFS=acgtn\r", None),
    ('chr1 10 20 "ID=a b;MOTIFS=AC"', None),
    ("chr1\t20\t10\tID=a;MOTIFS=AC", None),
    ("chr1\t0000000000010\t4294967295\tID=a;MOTIFS=AC;X=b=c", None),
    (None, "column_count"),
    ("", "column_count"),
    (" \t ", "column_count"),
    ("chr1\t10\t20", "column_count"),
    (GOOD + "\textra", "column_count"),
    ('chr1 10 20 "ID=a;MOTIFS=AC" more', "column_count"),
    (GOOD + '"', "bad_quote"),
    ('"chr1"\t10\t20\tID=a;MOTIFS=AC', "bad_quote"),
    ('chr1 10 20 "ID=a;"MOTIFS=AC"', "bad_quote"),
    ("chrom\tstart\tend\tinfo", "bad_start"),
    ("chr1\t-1\t20\tID=a;MOTIFS=AC", "bad_start"),
    ("chr1\t4294967296\t20\tID=a;MOTIFS=AC", "bad_start"),
    ("chr1\t1\t99999999999999999999999\tID=a;MOTIFS=AC", "bad_end"),
    ("chr1\t1\t2x\tID=a;MOTIFS=AC", "bad_end"),
    ("chr1\t1\t2\tID=a;;MOTIFS=AC", "bad_info"),
    ("chr1\t1\t2\tID=a;MOTIFS=AC;", "bad_info"),
    ("chr1\t1\t2\tID=;MOTIFS=AC", "bad_info"),
    ("chr1\t1\t2\tID=a;flag", "bad_info"),
    ('chr1 1 2 ""', "bad_info"),
    ("chr1\t1\t2\tID=a;MOTIFS=AC;ID=b", "duplicate_name"),
    ("chr1\t1\t2\tid=a;MOTIFS=AC", "missing_id"),
    ("chr1\t1\t2\tID=a", "missing_motifs"),
    ("chr1\t1\t2\tID=a;MOTIFS=AC,,G", "bad_motif"),
    ("chr1\t1\t2\tID=a;MOTIFS=AX", "bad_motif"),
    ("chr1\t1\t2\tID=a\nb;MOTIFS=AC", None),
    ("chr1\t1\t2\tID=" + "a" * 100_000 + ";MOTIFS=" + "ACGT" * 50_000, None),
]


def test_catalog_reasons_in_order():
    parsed = parse_catalog_lines(pa.array([line for line, _ in CASES]))
    assert parsed["reason"].to_pylist() == [reason for _, reason in CASES]
    loaded = parsed.to_pylist()
    assert loaded[0] == {"chrom": "chr1", "start_pos": 10, "end_pos": 20, "tr_id": "a", "motifs": ["AC", "G"], "motif_len": 1, "reason": None}
    assert loaded[2]["tr_id"] == "a b"
    assert loaded[-2]["tr_id"] == "a\nb"
    assert all(row["chrom"] is None for row in loaded if row["reason"])


def test_catalog_any_mix_of_lines_is_judged_alone():
    rng = random.Random(3)
    for _ in range(30):
        pick = [rng.choice(CASES) for _ in range(rng.randrange(0, 12))]
        assert parse_catalog_lines(pa.array([p[0] for p in pick], pa.string()))["reason"].to_pylist() == [p[1] for p in pick]


def test_load_catalog_frames(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (1, GOOD, "y"), (2, None, "z")], "line_id long, raw_line string, chrom string")
    rows = load_catalog(df).orderBy("line_id").collect()
    assert [r["reason"] for r in rows] == [None, None, "column_count"]
    assert load_catalog(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="named like"):
        load_catalog(df, keep=("chrom",))


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("small", [10_000, -1])
def test_broken_references_match_direct_model(spark, monkeypatch, small):
    monkeypatch.setattr(references, "SMALL_PARENT", small)
    rng = random.Random(5)
    parents = [(rng.choice(["a", "b", "c", None]), rng.randrange(2), _day(rng.randrange(20)), rng.choice([None, _day(rng.randrange(30))])) for _ in range(60)]
    children = [(i, rng.choice(["a", "b", "c", "gone", ".", None]), rng.choice([0, 1, None]), _day(rng.randrange(25))) for i in range(300)]
    p = spark.createDataFrame(parents, "id string, scope int, since timestamp_ntz, until timestamp_ntz")
    c = spark.createDataFrame(children, "rec long, ref string, scope int, at timestamp_ntz")
    got = broken_references(c, ["scope", "ref"], "at", p, ["scope", "id"], "since", "until", ["rec"], F.col("ref") != ".")
    want = set()
    for rec, ref, scope, at in children:
        if ref in (None, "."):
            continue
        targets = [x for x in parents if x[0] == ref and x[1] == scope and scope is not None]
        if not targets:
            want.add((rec, "missing"))
        elif not any(x[2] <= at and (x[3] is None or x[3] > at) for x in targets):
            want.add((rec, "late" if any(x[2] > at for x in targets) else "deleted"))
    rows = [(r["rec"], r["status"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want
    assert broken_references(c.limit(0), ["scope", "ref"], "at", p, ["scope", "id"], "since", "until", ["rec"]).count() == 0


def test_prefix_scan_equals_window_on_one_hot_key(spark):
    rows = [("hot" if i % 10 else None, i % 97, i, i % 7 - 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, i long, v int")
    got = prefix_scan(df, ["k"], ["o", "i"], {"s": ("sum", "v"), "m": ("max", "v")}, slices=9).collect()
    for key in ("hot", None):
        total, most = 0, None
        for r in sorted((r for r in got if r["k"] == key), key=lambda r: (r["o"], r["i"])):
            total, most = total + r["v"], r["v"] if most is None else max(most, r["v"])
            assert (r["s"], r["m"]) == (total, most)
    first = prefix_scan(df, ["k"], ["o", "i"], {"s": ("sum", "v"), "m": ("max", "v")}, exclusive=True).filter("o = 0 and i = 0").first()
    assert (first["s"], first["m"]) == (0, None)


def test_heavy_keys(spark):
    rows = [("a", "x")] * 50 + [("b", None)] * 30 + [(None, "x")] * 15 + [("c", "x")] * 5
    df = spark.createDataFrame(rows, "contig string, kind string")
    assert {(r[0], r[1]) for r in heavy_keys(df, ["contig", "kind"], 0.05).collect()} == {("a", "x"), ("b", None)}
    assert heavy_keys(df.limit(0), ["contig", "kind"], 0.05).count() == 0
    counted = per_key_distinct(df, ["contig"], "kind", "n").collect()
    assert {(r[0], r["n"]) for r in counted} == {("a", 1), (None, 1), ("c", 1)}
