"""Binary call files: decoded into the text lines that the text reader takes.

The format is the public BCF2 layout: a text header, then records with typed values.  Each file is decoded as a stream by one
task; files are spread over tasks.
"""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from callweave.sources.text import SourceError

# Fixed values of the format: type codes, and sentinels by width.
_WIDTH = {1: 1, 2: 2, 3: 4, 5: 4, 7: 1}
_MISSING = {1: -128, 2: -32768, 3: -(1 << 31)}
_END = {k: v + 1 for k, v in _MISSING.items()}
_FLOAT_MISSING, _FLOAT_END = 0x7F800001, 0x7F800002


def _dictionaries(header: str) -> tuple[dict[int, str], dict[int, str], int]:
    strings, contigs = {0: "PASS"}, {}
    place = {"PASS": 0}
    for line in header.splitlines():
        found = re.match(r"##(FILTER|INFO|FORMAT)=<.*?ID=([^,>]+)", line)
        index = re.search(r"[<,]IDX=(\d+)", line)
        if found:
            at = int(index[1]) if index else place.get(found[2], len(strings))
            if found[2] not in place:
                place[found[2]] = at
                strings[at] = found[2]
        found = re.match(r"##contig=<.*?ID=([^,>]+)", line)
        if found:
            contigs[int(index[1]) if index else len(contigs)] = found[1]
    columns = [x for x in header.splitlines() if x.startswith("#CHROM")]
    return strings, contigs, max(0, len(columns[0].split("\t")) - 9) if columns else 0


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def kind(self) -> tuple[int, int]:
        byte = self.data[self.at]
        self.at += 1
        size = byte >> 4
        if size == 15:
            size = self.value(*self.kind())[0]
        return byte & 15, size

    def value(self, code: int, size: int) -> list | str:
        """Numbers without padding; missing ones are None; text as str."""
        if code == 0:
            return []
        raw = self.take(_WIDTH[code] * size)
        if code == 7:
            return raw.split(b"\0")[0].decode("utf-8", "replace")
        if code == 5:
            bits, numbers = struct.unpack(f"<{size}I", raw), struct.unpack(f"<{size}f", raw)
            return [None if b == _FLOAT_MISSING else x for b, x in zip(bits, numbers) if b != _FLOAT_END]
        numbers = struct.unpack(f"<{size}{'bhi'[code - 1]}", raw)
        return [None if x == _MISSING[code] else x for x in numbers if x != _END[code]]


def _text(value: list | str) -> str:
    if isinstance(value, str):
        return value or "."
    show = lambda x: "." if x is None else (f"{x:.6g}" if isinstance(x, float) else str(x))
    return ",".join(map(show, value)) or "."


def _genotype(value: list) -> str:
    out = ""
    for i, x in enumerate(value):
        allele = "." if x is None or x >> 1 == 0 else str((x >> 1) - 1)
        out += ("" if i == 0 else "|" if x is not None and x & 1 else "/") + allele
    return out or "."


def text_lines(path: str) -> Iterator[str]:
    """Header lines and record lines of a binary file."""
    with gzip.open(path, "rb") as file:
        if file.read(5) != b"BCF\x02\x02":
            raise SourceError(f"{path} is no binary call file")
        header = file.read(struct.unpack("<I", file.read(4))[0]).rstrip(b"\0").decode()
        strings, contigs, _ = _dictionaries(header)
        yield from header.rstrip("\n").splitlines()
        while head := file.read(8):
            if len(head) < 8:
                raise SourceError(f"{path} ends within a record")
            shared, single = struct.unpack("<II", head)
            r, body = _Reader(file.read(shared)), file.read(single)
            chrom, pos, _, qual, counts, samples = struct.unpack("<iiiIII", r.take(24))
            n_info, n_allele, n_format, n_sample = counts & 0xFFFF, counts >> 16, samples >> 24, samples & 0xFFFFFF
            ident = r.value(*r.kind()) or "."
            alleles = [r.value(*r.kind()) for _ in range(n_allele)]
            filters = r.value(*r.kind())
            info = []
            for _ in range(n_info):
                tag = strings[r.value(*r.kind())[0]]
                code, size = r.kind()
                value = r.value(code, size)
                info.append(tag if code == 0 else f"{tag}={_text(value)}")
            f, tags, cells = _Reader(body), [], [[] for _ in range(n_sample)]
            for _ in range(n_format):
                tag = strings[f.value(*f.kind())[0]]
                code, size = f.kind()
                tags.append(tag)
                for cell in cells:
                    value = f.value(code, size)
                    cell.append(_genotype(value) if tag == "GT" else _text(value))
            quality = "." if qual == _FLOAT_MISSING else f"{struct.unpack('<f', struct.pack('<I', qual))[0]:.6g}"
            fixed = [contigs[chrom], str(pos + 1), ident, alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".", quality]
            fixed += [";".join(strings[x] for x in filters) or ".", ";".join(info) or "."]
            yield "\t".join([*fixed, *([":".join(tags)] if tags else []), *(":".join(c) for c in cells)])


def binary_lines(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """(vcf_id, line_no, value) of all files, decoded on the executors; the paths must be on storage they share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for vcf_id, path in zip(frame["vcf_id"], frame["path"]):
                rows: list[tuple[int, int, str]] = []
                for n, line in enumerate(text_lines(path)):
                    rows.append((vcf_id, n, line))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["vcf_id", "line_no", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["vcf_id", "line_no", "value"])

    listed = spark.createDataFrame(list(paths.items()), "vcf_id int, path string").repartition(len(paths), "vcf_id")
    return listed.mapInPandas(run, "vcf_id int, line_no bigint, value string")
