import gzip
import struct

import pytest

from callweave.__main__ import main
from callweave.config import ConfigError, MergeConfig
from callweave.plans.merge import merge_breakends, merge_files, orphans_in_scope
from callweave.sinks.diagnostics import diagnostics
from callweave.sinks.vcf import _block, output_kind, write_file
from callweave.sources import bcf, vcf
from callweave.sources.text import SourceError, path_list, repeat_catalog
from callweave.streaming import incremental

HEAD = '##fileformat=VCFv4.2\n##contig=<ID=chr1,length=10000>\n##contig=<ID=chr2>\n##FORMAT=<ID=GT,Number=1,Type=String,Description="">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t'
A = [
    "chr1\t101\tx1\tA\tACGTACGTAC\t.\t.\tSVTYPE=INS;SVLEN=9\tGT:GQ\t0/1:20",
    "chr1\t501\tx2\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-50;END=551;SVCLAIM=DJ\tGT:GQ\t1/1:9",
    "chr2\t5\tq:CNV:1\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-70;SVCLAIM=D\tGT:CN:CNQ\t0/1:1:9",
    "chr2\t900\tx4\tN\t<DUP>\t.\t.\tSVTYPE=DUP;SVLEN=40\tGT\t0/0",
]
B = [
    "chr1\t103\ty1\tA\tACGTACGTAC\t.\t.\tSVTYPE=INS;SVLEN=9\tGT:GQ\t0/1:30\t0/0:5",
    "chr1\t505\ty2\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-52;SVCLAIM=DJ\tGT:GQ\t0/1:9\t0/1:8",
]


def write(path, samples, rows):
    path.write_text(HEAD + "\t".join(samples) + "\n" + "\n".join(rows) + "\n")
    return str(path)


@pytest.fixture()
def files(tmp_path):
    return [write(tmp_path / "a.vcf", ["s1"], A), write(tmp_path / "b.vcf", ["s2", "s3"], B)]


def test_merge_end_to_end(spark, files, tmp_path):
    (tmp_path / "t.bed").write_text("chr1\t90\t120\tID=TR1;MOTIFS=ACGT\n")
    found = merge_files(spark, files, MergeConfig(), str(tmp_path / "t.bed"))
    lines = [r["line"].split("\t") for r in found.lines(True).collect()]
    assert [line[:5] for line in lines] == [["chr1", "101", "0_x1", "A", "ACGTACGTAC"], ["chr1", "501", "0_x2", "N", "<DEL>"], ["chr2", "5", "0_q:CNV:1", "N", "<CNV>"]]
    assert "SUPP=2;SUPP_CALLS=2;IDLIST=0_x1,1_y1;TR_CONTAINED=TR1" in lines[0][7]
    assert lines[0][8:] == ["GT:GQ", "0/1:20", "0/1:30", "./.:."]
    assert lines[1][8:] == ["GT:GQ", "1/1:9", "0/1:9", "0/1:8"]
    assert "SVLEN=-51;END=552" in lines[1][7] and "SVCLAIM=DJ" in lines[1][7]
    assert lines[2][8:] == ["GT:CN:CNQ", "0/1:1:9", "./.:.:.", "./.:.:."]
    assert "SVCLAIM_SET=D" in lines[2][7]
    path = str(tmp_path / "out.vcf.gz")
    assert write_file(found.lines(True), found.header(), path, index=True) == 3
    vcf.validate(path)
    assert gzip.open(path, "rt").read().count("\n0") == 0
    assert gzip.open(path + ".tbi").read(4) == b"TBI\x01"
    again = merge_files(spark, [path], MergeConfig(force_single=True))
    assert sorted(r["supp_calls"] for r in again.records.collect()) == [1, 2, 2]
    kinds = {r["record_type"] for r in diagnostics(found.calls, found.membership).collect()}
    assert kinds == {"kd_coord", "group_variant", "group_size_count"}


def test_rejections(spark, files, tmp_path):
    with pytest.raises(ConfigError):
        merge_files(spark, files[:1])
    with pytest.raises(SourceError, match="twice"):
        merge_files(spark, [files[0], files[0]])
    packed = tmp_path / "p.vcf.gz"
    packed.write_bytes(gzip.compress(b"##fileformat=VCFv4.2\n"))
    with pytest.raises(SourceError, match="plain gzip"):
        vcf.validate(str(packed))
    with pytest.raises(SourceError, match="no header"):
        merge_files(spark, files, MergeConfig(contig=("chrZ",)))
    with pytest.raises(ValueError):
        output_kind("x.bcf")
    other = write(tmp_path / "c.vcf", ["s9"], [])
    (tmp_path / "c.vcf").write_text((tmp_path / "c.vcf").read_text().replace("length=10000", "length=5"))
    with pytest.raises(SourceError, match="lengths"):
        vcf.contig_order([vcf.read_header(files[0]), vcf.read_header(other)])


BROKEN = [
    ("SVTYPE=DEL", "SVLEN is missing"),
    ("SVLEN=5", "SVTYPE is missing"),
    ("SVTYPE=XXX;SVLEN=5", "unknown SVTYPE"),
    ("SVTYPE=DEL;SVLEN=-5;CIPOS=-1,1", "incomplete CI"),
    ("SVTYPE=INS;SVLEN=5;CIEND=-1,1", "CIEND on an insertion"),
    ("SVTYPE=DEL;SVLEN=-5;CIPOS=2,1;CIEND=0,0", "two ordered"),
]


@pytest.mark.parametrize("info,message", BROKEN)
def test_broken_records_name_the_field(spark, tmp_path, info, message):
    path = write(tmp_path / "x.vcf", ["s"], [f"chr1\t9\ti\tN\t<DEL>\t.\t.\t{info}\tGT\t0/1"])
    calls = vcf.derive_calls(vcf.raw_records(spark, [path]), [vcf.read_header(path)], MergeConfig())
    with pytest.raises(Exception, match=message):
        calls.collect()


def test_unselected_broken_rows_do_no_harm(spark, tmp_path):
    path = write(tmp_path / "x.vcf", ["s"], [A[0], "chr1\t9\ti\tN\t<DEL>\t.\t.\tSVTYPE=DEL\tGT\t0/1"])
    calls = vcf.derive_calls(vcf.raw_records(spark, [path]), [vcf.read_header(path)], MergeConfig(svtype=("INS",)))
    assert [r["raw_id"] for r in calls.collect()] == ["x1"]


def test_moments_of_merged_input(spark, tmp_path):
    row = "chr1\t120\tm\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-20;END=140;CIPOS=-20,20;CIEND=-10,30;SUPP_CALLS=2\tGT\t0/1"
    path = write(tmp_path / "x.vcf", ["s"], [row])
    r = vcf.derive_calls(vcf.raw_records(spark, [path]), [vcf.read_header(path)], MergeConfig()).first()
    assert r["start_mean"] == 120 and abs(r["start_variance"] - 104.123281965847) < 1e-9
    assert r["svlen_mean"] == -30 and abs(r["svlen_variance"] - 208.246563931694) < 1e-9
    assert r["support_calls"] == 2


def test_small_inputs(spark, tmp_path, files, capsys):
    (tmp_path / "list").write_text("# a comment\n\n" + "\n".join(files) + "\n")
    assert path_list(str(tmp_path / "list")) == files
    (tmp_path / "list").write_text("#\n")
    with pytest.raises(SourceError):
        path_list(str(tmp_path / "list"))
    (tmp_path / "bad.bed").write_text("track name=x\n")
    with pytest.raises(Exception, match="does not load"):
        repeat_catalog(spark, str(tmp_path / "bad.bed")).collect()
    assert repeat_catalog(spark, str(tmp_path / "bad.bed"), strict=False).count() == 0
    assert main(["merge", "--vcf", *files, "--print-header"]) == 0
    assert "#CHROM" in capsys.readouterr().out


def test_incremental_batches_equal_one_shot(spark, tmp_path):
    rows = [("k", i % 3 + 1, float(i), 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, support_calls long, start_mean double, start_variance double")
    whole = incremental.batch_states(df, ["k"]).first()
    folder = str(tmp_path / "state")
    incremental.add_batch(spark, df.filter("start_mean < 4"), 0, folder, ["k"])
    for _ in range(2):  # a replayed batch counts once
        incremental.add_batch(spark, df.filter("start_mean >= 4"), 1, folder, ["k"])
    got = spark.read.parquet(incremental.latest_version(folder)).first()
    assert got["support_calls"] == whole["support_calls"]
    assert abs(got["mean"] - whole["mean"]) < 1e-9 and abs(got["variance"] - whole["variance"]) < 1e-9


def _bnd(pos, name, alt, mate, extra=""):
    contig, at = pos
    return f"{contig}\t{at}\t{name}\tN\t{alt}\t.\t.\tSVTYPE=BND;MATEID={mate}{extra}\tGT\t0/1"


def test_breakends_of_files(spark, tmp_path):
    first = write(tmp_path / "a.vcf", ["s1"], [_bnd(("chr1", 200), "a0", "]chr2:100]N", "a1"), _bnd(("chr2", 105), "a1", "]chr1:205]N", "a0", ";HOMLEN=5"), _bnd(("chr1", 9), "lone", "N[chr2:7[", "none")])
    second = write(tmp_path / "b.vcf", ["s2"], [_bnd(("chr1", 204), "b0", "]chr2:104]N", "b1"), _bnd(("chr2", 104), "b1", "]chr1:204]N", "b0"), _bnd(("chr1", 200), "c0", "N[chr2:100[", "c1"), _bnd(("chr2", 100), "c1", "N[chr1:200[", "c0")])
    got = merge_breakends(spark, [first, second]).orderBy("strands", "contig").collect()
    assert [(r["contig"], r["strands"], r["supp"], r["supp_calls"]) for r in got] == [("chr1", "++", 1, 1), ("chr2", "++", 1, 1), ("chr1", "--", 2, 2), ("chr2", "--", 2, 2)]
    both = got[2:]
    assert both[0]["mate_id"] == both[1]["id"] and both[1]["mate_id"] == both[0]["id"]
    assert (both[0]["pos"], both[0]["alt"]) == (202, "]chr2:102]N")
    bad = write(tmp_path / "c.vcf", ["s3"], [_bnd(("chr1", 200), "a0", "]chr2:100]N", "a1"), _bnd(("chr2", 300), "a1", "]chr1:200]N", "a0")])
    with pytest.raises(Exception, match="mates disagree: position"):
        merge_breakends(spark, [bad]).collect()
    odd = write(tmp_path / "d.vcf", ["s4"], [_bnd(("chr1", 200), "a0", "]chr2:100]N", "a1", ";CHR2=chr1")])
    with pytest.raises(Exception, match="CHR2"):
        merge_breakends(spark, [odd]).collect()


def test_command_line_with_breakends(spark, tmp_path):
    """Two files, three samples, a deletion and an inversion's breakends: every line has the header's columns."""
    info = ";HOMLEN=0;EVENT=i1;EVENTTYPE=INV"
    mate = lambda pos, name, ref, alt, other, gts: f"{pos[0]}\t{pos[1]}\t{name}\t{ref}\t{alt}\t.\tInvBreakpoint\tSVTYPE=BND;MATEID={other}{info}\tGT:GQ\t{gts}"
    one = write(tmp_path / "a.vcf", ["s1"], [A[1], mate(("chr1", 200), "p", "G", "]chr1:900]G", "q", "0/1:9"), mate(("chr1", 900), "q", "T", "T[chr1:200[", "p", "0/1:9")])
    two = write(tmp_path / "b.vcf", ["s2", "s3"], [B[1], mate(("chr1", 202), "u", "C", "]chr1:903]CA", "v", "0/1:5\t1/1:6"), mate(("chr1", 903), "v", "A", "A[chr1:202[", "u", "0/1:5\t1/1:6")])
    for path in (one, two):
        text = open(path).read().replace("##FORMAT=<ID=GT", '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="q">\n##FORMAT=<ID=GT')
        open(path, "w").write(text)
    out = tmp_path / "out.vcf"
    assert main(["merge", "--vcf", one, two, "-o", str(out), "--sort-output"]) == 0
    lines = out.read_text().splitlines()
    head = [x for x in lines if x.startswith("#CHROM")][0].split("\t")
    rows = [dict(zip(head, x.split("\t"))) for x in lines if not x.startswith("#")]
    assert all(len(x.split("\t")) == len(head) == 12 for x in lines if not x.startswith("#"))
    assert any(x.startswith("##FORMAT=<ID=GQ") for x in lines) and any(x.startswith("##callweave_command=callweave merge") for x in lines)
    a, cut_out, b = rows
    assert (a["POS"], a["ID"], a["REF"], a["ALT"], a["FILTER"]) == ("201", "i1_A", "C", "]chr1:902]CA", "InvBreakpoint")
    assert (b["POS"], b["ID"], b["REF"], b["ALT"]) == ("902", "i1_B", "A", "A[chr1:201[")
    assert "STRANDS=--" in a["INFO"] and "STRANDS=++" in b["INFO"] and "SUPP=3;SUPP_CALLS=2" in a["INFO"] and "CIPOS=-2,2" in a["INFO"] and "EVENTTYPE=INV" in b["INFO"]
    assert (a["FORMAT"], a["s1"], a["s2"], a["s3"]) == ("GT:GQ", "0/1:9", "0/1:5", "1/1:6")
    assert cut_out["ALT"] == "<DEL>"


def test_claimed_twice_and_scope(spark, tmp_path):
    rows = [_bnd(("chr1", 200), "m", "]chr2:100]N", "n"), _bnd(("chr2", 100), "n", "]chr1:200]N", "m"), _bnd(("chr2", 100), "n", "]chr1:200]N", "m")]
    path = write(tmp_path / "a.vcf", ["s1"], rows)
    with pytest.raises(Exception, match="several mates"):
        merge_breakends(spark, [path]).collect()
    path = write(tmp_path / "b.vcf", ["s1"], [*rows[:2], _bnd(("chr1", 9), "lone", "N[chr2:7[", "gone")])
    assert merge_breakends(spark, [path]).count() == 2
    assert merge_breakends(spark, [path], MergeConfig(contig=("chr1",))).count() == 0
    assert [r["id"] for r in orphans_in_scope(spark, [path], MergeConfig()).collect()] == ["0_lone"]
    assert orphans_in_scope(spark, [path], MergeConfig(contig=("chr1",))).count() == 0


def test_averages_give_the_plane_point(spark, tmp_path):
    rows = [_bnd(("chr1", 200), "m", "]chr2:100]N", "n", ";AVG_START=201.5;AVG_END=99.25;CIPOS=-2,2"), _bnd(("chr2", 100), "n", "]chr1:200]N", "m", ";AVG_START=99.25;AVG_END=201.5")]
    path = write(tmp_path / "a.vcf", ["s1"], rows)
    found = {r["id"]: r for r in vcf.derive_breakends(vcf.raw_records(spark, [path]), [vcf.read_header(path)], MergeConfig()).collect()}
    assert (found["0_m"]["start"], found["0_m"]["end"]) == (found["0_n"]["start"], found["0_n"]["end"]) == (200.5, 98.25)
    assert abs(found["0_m"]["start_variance"] - (2 / 1.96) ** 2) < 1e-12 and found["0_n"]["start_variance"] == 0


def test_formats_of_members(spark, tmp_path):
    """Genotypes are padded to the record's ploidy; a tag of two types in one cluster is an error."""
    one = write(tmp_path / "a.vcf", ["s1"], ["chr1\t501\tx\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-50\tGT:GQ\t1:9"])
    two = write(tmp_path / "b.vcf", ["s2", "s3"], ["chr1\t501\ty\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-50\tGT:GQ\t0/1/1:9\t0/0/0:1"])
    cells = merge_files(spark, [one, two], MergeConfig()).records.first()["cells"]
    assert cells == ["1/./.:9", "0/1/1:9", "././.:."]
    for path, kind in ((one, "Integer"), (two, "Float")):
        text = open(path).read().replace("##FORMAT=<ID=GT", f'##FORMAT=<ID=GQ,Number=1,Type={kind},Description="q">\n##FORMAT=<ID=GT')
        open(path, "w").write(text)
    with pytest.raises(Exception, match="different types"):
        merge_files(spark, [one, two], MergeConfig()).records.collect()


def test_merged_files_keep_their_samples(spark, tmp_path):
    """Ids that begin with a sample's number follow the sample; others get the file's ordinal."""
    one = write(tmp_path / "a.vcf", ["s1"], ["chr1\t501\t0_x\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-50;IDLIST=0_x,7_y\tGT\t0/1"])
    two = write(tmp_path / "b.vcf", ["s2", "s3"], ["chr1\t901\t1_z\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-50;IDLIST=1_z,0_w\tGT\t0/1\t0/1"])
    got = {r["id"]: r["id_list"] for r in vcf.derive_calls(vcf.raw_records(spark, [one, two]), [vcf.read_header(one), vcf.read_header(two)], MergeConfig()).collect()}
    assert got == {"0_x": ["0_x", "0_7_y"], "2_z": ["2_z", "1_w"]}


def _typed(code, values, size=None):
    kind = {1: "b", 2: "h", 3: "i", 5: "f"}
    if code == 7:
        raw = values.encode()
        head = bytes([len(raw) << 4 | 7]) if len(raw) < 15 else bytes([0xF7, 0x11, len(raw)])
        return head + raw
    return bytes([len(values) << 4 | code]) + struct.pack(f"<{len(values)}{kind[code]}", *values)


def test_binary_files_read_like_text(spark, files, tmp_path):
    header = (
        HEAD.replace("##contig", '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="">\n##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="">\n##contig', 1)
        .replace('##FORMAT=<ID=GT', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="">\n##FORMAT=<ID=GT')
        + "s8\ts9\n"
    )
    text = header.encode() + b"\0"
    shared = struct.pack("<iiiIII", 0, 102, 1, 0x7F800001, 2 << 16 | 2, 2 << 24 | 2)
    shared += _typed(7, "z1") + _typed(7, "A") + _typed(7, "ACGTACGTACGTACGTACGT") + b"\x00" + _typed(1, [1]) + _typed(7, "INS") + _typed(1, [2]) + _typed(2, [300])
    single = _typed(1, [4]) + bytes([2 << 4 | 1]) + bytes([2, 4, 2, 0x81]) + _typed(1, [3]) + bytes([1 << 4 | 1]) + struct.pack("<bb", 50, -128)
    path = tmp_path / "x.bcf"
    path.write_bytes(_block(b"BCF\x02\x02" + struct.pack("<I", len(text)) + text + struct.pack("<II", len(shared), len(single)) + shared + single))
    vcf.validate(str(path))
    assert list(bcf.text_lines(str(path)))[-1] == "chr1\t103\tz1\tA\tACGTACGTACGTACGTACGT\t.\t.\tSVTYPE=INS;SVLEN=300\tGT:GQ\t0/1:50\t0:."
    found = merge_files(spark, [files[0], str(path)], MergeConfig())
    assert found.samples == ("s1", "s8", "s9")
    assert {r["id"] for r in found.records.collect()} >= {"1_z1", "0_x1"}
