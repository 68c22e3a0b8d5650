"""Writing merged records as call-file text, plain or packed in blocks, with an index."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave import __version__

#: The INFO and FILTER fields of merged records.
_INFO = """SVTYPE:1:String:Class of the event
SVLEN:1:Integer:Length, negative for deletions
END:1:Integer:Last position
CIPOS:2:Integer:Interval around POS
CIEND:2:Integer:Interval around END
SUPP:1:Integer:Samples with support
SUPP_CALLS:1:Integer:Calls merged
IDLIST:.:String:Ids of the merged calls
SVCLAIM:1:String:Claim made by all merged calls
SVCLAIM_SET:.:String:Claims made by the merged calls
TR_CONTAINED:1:String:Tandem repeat that holds the event
MATEID:.:String:Id of the mate
CHR2:1:String:Contig of the mate
STRANDS:1:String:Orientation
EVENT:1:String:Id of the event
EVENTTYPE:1:String:Class of the event as a whole"""
_EMPTY_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def header_text(contigs: dict[str, int | None], samples: Iterable[str], declared: Iterable[str] = (), version: bool = True, command: str | None = None) -> str:
    """The header of a merged file; also what header-only mode prints.

    ``declared`` are the INFO, FILTER and FORMAT lines of the inputs; the fields that a merge itself writes are declared as it writes them.
    """
    own = ['##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=InvBreakpoint,Description="Breakpoint of an inversion">']
    for row in _INFO.splitlines():
        name, number, kind, text = row.split(":")
        own.append(f'##INFO=<ID={name},Number={number},Type={kind},Description="{text}">')
    own.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
    field = lambda line: re.match(r"##(\w+)=<(?:.*?,)?ID=([^,>]+)", line).groups()
    mine = {field(line) for line in own}
    lines = ["##fileformat=VCFv4.2", *own, *[line for line in declared if field(line) not in mine]]
    lines += [f"##contig=<ID={c}" + (f",length={n}" if n is not None else "") + ">" for c, n in contigs.items()]
    if version:
        lines.append(f"##callweave_version={__version__}")
        if command:
            lines.append(f"##callweave_command={command}")
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]) + "\n"


def record_lines(records: DataFrame) -> DataFrame:
    """One text line per merged record; columns that are null leave no INFO item.

    Expects the columns of ``merged_records`` and optionally ref, alt, format, cells (rendered samples) and the mate fields.
    """
    have = set(records.columns)
    column = lambda c, otherwise: F.coalesce(F.col(c).cast("string"), F.lit(otherwise)) if c in have else F.lit(otherwise)
    items = []
    for tag, name in {
        "SVTYPE": "svtype", "SVLEN": "svlen", "END": "end", "CIPOS": "cipos", "CIEND": "ciend", "SUPP": "supp", "SUPP_CALLS": "supp_calls", "IDLIST": "idlist",
        "SVCLAIM": "svclaim", "SVCLAIM_SET": "svclaim_set", "TR_CONTAINED": "tr_contained", "MATEID": "mate_id", "CHR2": "mate_contig", "STRANDS": "strands", "EVENT": "event", "EVENTTYPE": "eventtype",
    }.items():
        if name in have:
            value = F.array_join(F.col(name).cast("array<string>"), ",") if dict(records.dtypes)[name].startswith("array") else F.col(name).cast("string")
            items.append(F.concat(F.lit(f"{tag}="), value))
    symbolic = F.concat(F.lit("<"), F.col("svtype"), F.lit(">")) if "svtype" in have else F.lit(".")
    alt = F.coalesce(F.col("alt"), symbolic) if "alt" in have else symbolic
    cells = F.array_join("cells", "\t") if "cells" in have else F.lit("./.")
    parts = ["contig", F.col("pos").cast("string"), "id", column("ref", "N"), alt, F.lit("."), column("filter", "."), F.concat_ws(";", *items), column("format", "GT"), cells]
    stop = F.coalesce(F.col("end").cast("bigint"), F.col("pos")) if "end" in have else F.col("pos")
    alleles = F.concat(F.array(column("ref", "N")), F.split(alt, ","))
    return records.select("contig", "pos", stop.alias("stop"), alleles.alias("alleles"), F.concat_ws("\t", *parts).alias("line"))


def sorted_lines(lines: DataFrame, contigs: dict[str, int | None]) -> DataFrame:
    """Global order by contig rank, position, alleles and line; Spark sorts by ranges and spills as it must."""
    order = list(contigs)
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("contig"))
    return lines.withColumn("rid", F.when(rank == 0, F.raise_error(F.concat(F.lit("contig is in no header: "), "contig")).cast("int")).otherwise(rank - 1)).orderBy("rid", "pos", "alleles", "line")


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(body) + 25
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BlockWriter:
    """Packs bytes in independent blocks and knows the virtual offset of what comes next."""

    def __init__(self, path: str):
        self.file, self.held, self.done = open(path, "wb"), bytearray(), 0

    def tell(self) -> int:
        return self.done << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= 0xFF00:
            self._flush(0xFF00)

    def _flush(self, n: int) -> None:
        packed = _block(bytes(self.held[:n]))
        self.file.write(packed)
        self.done += len(packed)
        del self.held[:n]

    def close(self) -> None:
        if self.held:
            self._flush(len(self.held))
        self.file.write(_EMPTY_BLOCK)
        self.file.close()


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the public tabix scheme that holds [begin, end)."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return offset + (begin >> shift)
    return 0


class Index:
    """A tabix index, built while sorted records are written: what is kept grows with bins and windows, not with records."""

    def __init__(self) -> None:
        self.parts: dict[str, tuple[dict[int, list[list[int]]], list[int]]] = {}

    def add(self, contig: str, begin: int, end: int, first: int, last: int) -> None:
        """A record over [begin, end) whose line lies between two virtual offsets."""
        bins, linear = self.parts.setdefault(contig, ({}, []))
        chunks = bins.setdefault(_bin(begin, end), [])
        if chunks and chunks[-1][1] >> 16 == first >> 16:
            chunks[-1][1] = last
        else:
            chunks.append([first, last])
        top = (end - 1) >> 14
        if len(linear) <= top:
            linear += [linear[-1] if linear else first] * ((begin >> 14) - len(linear))
            linear += [first] * (top + 1 - len(linear))

    def write(self, path: str) -> None:
        joined = b"".join(n.encode() + b"\0" for n in self.parts)
        out = struct.pack("<4siiiiiiii", b"TBI\x01", len(self.parts), 2, 1, 2, 0, ord("#"), 0, len(joined)) + joined
        for bins, linear in self.parts.values():
            out += struct.pack("<i", len(bins))
            for number, chunks in bins.items():
                out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            out += struct.pack("<i", len(linear)) + b"".join(struct.pack("<Q", x) for x in linear)
        index = BlockWriter(f"{path}.tbi")
        index.write(out)
        index.close()


def output_kind(path: str, kind: str | None = None) -> str:
    """``v`` text or ``z`` packed text: the given kind, else by extension; binary output is not offered."""
    if kind is None:
        kind = "z" if path.endswith((".vcf.gz", ".vcf.bgz")) else "u" if path.endswith((".bcf", ".bcf.gz")) else "v"
    if kind not in ("v", "z"):
        raise ValueError(f"output kind {kind!r} is not offered; write v or z")
    return kind


def write_file(lines: DataFrame, header: str, path: str, kind: str | None = None, index: bool = False) -> int:
    """One file from sorted or unsorted lines, streamed partition by partition through the driver; returns the records.

    A single file needs a single writer; ``write_parts`` is the form for results that should stay distributed.
    """
    packed = output_kind(path, kind) == "z"
    target = BlockWriter(path) if packed else open(path, "wb")
    target.write(header.encode())
    places = Index()
    count = 0
    for row in lines.toLocalIterator(prefetchPartitions=True):
        first = target.tell()
        target.write(row["line"].encode() + b"\n")
        if packed and index:
            places.add(row["contig"], row["pos"] - 1, max(row["pos"], row["stop"]), first, target.tell())
        count += 1
    target.close()
    if packed and index:
        places.write(path)
    return count


def write_parts(lines: DataFrame, header: str, folder: str) -> None:
    """Distributed text output: ordered part files beside a header file."""
    lines.select("line").write.text(f"{folder}/records")
    Path(folder, "header.txt").write_text(header)
