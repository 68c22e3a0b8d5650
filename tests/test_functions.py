import pytest
from pyspark.sql import functions as F

from callweave.config import BALANCED, ConfigError, MergeConfig, byte_size, from_toml, selected_classes
from callweave.functions import breakends, info
from callweave.functions.predicates import overlaps_match, sequences_match, side, size_similarity, text_similar
from callweave.functions.scalars import checked_int, fnv1a, rotated, round_half_up, text_hash
from callweave.operators.shards import coalesced
from callweave.sources.text import SourceError, region, regions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, text_hash(F.lit("AB"))) == 1171
    assert one(spark, text_hash(F.lit("SVTYPE=DEL;SVLEN=-20"))) == 814252598
    assert one(spark, text_hash(F.lit(""))) == 0
    assert one(spark, round_half_up(F.lit(-2.5))) == -2
    assert one(spark, rotated(F.lit("ACGT"), F.lit(-1))) == "CGTA"
    assert one(spark, rotated(F.lit(""), F.lit(3))) == ""
    assert fnv1a(b"") == 0xCBF29CE484222325
    with pytest.raises(Exception, match="32 bits"):
        one(spark, checked_int(F.lit(1 << 40), "END"))


def test_info_fields(spark):
    m = info.info_map(F.lit("SVTYPE=DEL;IDS=a,.,b,;FLAG;SVLEN=-5"))
    assert one(spark, info.values(m, "IDS")) == ["a", "b"]
    assert one(spark, info.first_number(m, "SVLEN")) == -5.0
    assert one(spark, info.values(m, "FLAG")) == []
    assert one(spark, info.first_value(m, "NONE")) is None
    assert one(spark, info.first_value(info.info_map(F.lit(".")), "X")) is None
    assert one(spark, info.has_filter(F.lit("a;bc"), "b")) is False
    assert one(spark, info.is_cnv_id(F.lit("q:CNV:1"))) is True


@pytest.mark.parametrize("alt,want", [("]chr9:200]N", "--"), ("[chr9:200[N", "+-"), ("N[chr9:200[", "++"), ("N]chr9:200]", "-+")])
def test_four_orientations(spark, alt, want):
    a = F.lit(alt)
    assert one(spark, breakends.strands(a)) == want
    assert one(spark, breakends.mate_contig(a)) == "chr9"
    assert one(spark, breakends.mate_pos0(a)) == 199
    assert one(spark, breakends.alt_allele(F.lit("chr9"), F.lit(200), F.lit(want), F.lit("N"))) == alt


def test_breakend_details(spark):
    assert one(spark, breakends.mate_contig(F.lit("N[HLA:A:7["))) == "HLA:A"
    assert one(spark, breakends.strands(F.lit("N[c:1["), F.lit("--"))) == "--"
    point = one(spark, breakends.plane_point(F.lit("chr9"), F.lit(99), F.lit("chr1"), F.lit(199)))
    assert (point["start"], point["end"]) == (199.0, 99.0)
    with pytest.raises(Exception, match="orientation"):
        one(spark, breakends.alt_allele(F.lit("c"), F.lit(1), F.lit("??"), F.lit("N")))


def pair(spark, a, b):
    base = {"start": 0.0, "svlen": 10.0, "svtype": "INS", "trid": None, "motif_len": 0, "sequence": None, "interval_start": None, "interval_end": None}
    kinds = {"start": "double", "svlen": "double", "svtype": "string", "trid": "string", "motif_len": "int", "sequence": "string", "interval_start": "double", "interval_end": "double"}
    row = {f"a_{k}": v for k, v in {**base, **a}.items()} | {f"b_{k}": v for k, v in {**base, **b}.items()}
    schema = ", ".join(f"{p}_{k} {t}" for p in "ab" for k, t in kinds.items())
    return spark.createDataFrame([tuple(row[f"{p}_{k}"] for p in "ab" for k in kinds)], schema)


def test_predicates(spark):
    a, b = side("a_"), side("b_")
    sized = pair(spark, {"svlen": -10.0}, {"svlen": 0.0})
    assert sized.select(size_similarity(a, b)).first()[0] == 0.1
    half = pair(spark, {"interval_start": 100.0, "interval_end": 200.0}, {"interval_start": 150.0, "interval_end": 250.0})
    assert half.select(overlaps_match(a, b, F.lit(0.5))).first()[0] is True
    assert half.select(overlaps_match(a, b, F.lit(0.6))).first()[0] is False
    apart = pair(spark, {"interval_start": 0.0, "interval_end": 10.0}, {"interval_start": 10.0, "interval_end": 20.0})
    assert apart.select(overlaps_match(a, b, F.lit(0.0))).first()[0] is False
    cfg = MergeConfig(tr_min_sequence_similarity=0.95)
    turned = pair(spark, {"start": 100.0, "sequence": "ACGTACGT", "trid": "t", "motif_len": 4}, {"start": 101.0, "sequence": "CGTACGTA", "trid": "t", "motif_len": 4})
    assert turned.select(sequences_match(a, b, cfg)).first()[0] is True
    other = pair(spark, {"start": 100.0, "sequence": "ACGTACGT", "trid": "t", "motif_len": 4}, {"start": 101.0, "sequence": "CGTACGTA", "trid": "u", "motif_len": 4})
    assert other.select(sequences_match(a, b, MergeConfig(min_sequence_similarity=0.95))).first()[0] is False
    near = F.lit(0.6).cast("float")
    assert one(spark, text_similar(F.lit("A" * 10), F.lit("A" * 20), near)) is False
    assert one(spark, text_similar(F.lit(""), F.lit(""), F.lit(0.0).cast("float"))) is True
    assert one(spark, text_similar(F.lit(""), F.lit(""), F.lit(0.1).cast("float"))) is False


def test_config(tmp_path):
    assert selected_classes("ins,del") == ("INS", "DEL")
    assert byte_size("768M") == 768_000_000
    assert BALANCED.merge_constraint == "clique"
    for bad in ({"max_dist": -1}, {"min_dist": -2}, {"knn_search_k": 0}, {"min_supp": 0}, {"merge_constraint": "x"}, {"sort_merge_fan_in": 99}, {"sort_max_mem": "0"}, {"svtype": ("X",)}):
        with pytest.raises(ConfigError):
            MergeConfig(**bad)
    path = tmp_path / "m.toml"
    path.write_text("[merge]\nmax_dist = 5\nsvtype = ['DEL']\n")
    assert from_toml(path, min_supp=2) == MergeConfig(max_dist=5, svtype=("DEL",), min_supp=2)
    path.write_text("nonsense = 1\n")
    with pytest.raises(ConfigError):
        from_toml(path)


def test_regions_and_coalescing():
    assert region("(chr1:1-10)") == ("chr1", 0, 9)
    assert regions("(chr1:5),(chr2:7-7)") == [("chr1", 4, None), ("chr2", 6, 6)]
    for bad in ("chr1:1", "(chr1:0)", "(chr1:9-3)", "(:1)"):
        with pytest.raises(SourceError):
            region(bad)
    assert coalesced([1, 1, 2, 1, 1], 3) == [[0, 1, 2, 3, 4]]
    assert coalesced([3, 3], 3) == [[0], [1]]
