"""Small text inputs: path lists, target regions, repeat catalogs as files, compression checks."""

from __future__ import annotations

import gzip
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators.ingest import load_catalog


class SourceError(ValueError):
    """An input can't be read as what it should be."""


def path_list(path: str) -> list[str]:
    """Paths of a list file: one a line, blank lines and ``#`` lines skipped; a missing file or an empty list is an error."""
    found = [line.strip() for line in Path(path).read_text().splitlines() if line.strip() and not line.strip().startswith("#")]
    missing = [p for p in found if not Path(p).exists()]
    if missing:
        raise SourceError(f"listed files are missing: {missing[:5]}")
    if not found:
        raise SourceError(f"{path} lists no files")
    return found


_REGION = re.compile(r"\(([^:]+):(\d+)(?:-(\d+))?\)")


def region(text: str) -> tuple[str, int, int | None]:
    """``(contig:start[-end])``, 1-based and inclusive, as (contig, first, last) from zero; last is None if open."""
    found = _REGION.fullmatch(text.strip())
    if not found:
        raise SourceError(f"not a region: {text!r}")
    contig, start, end = found[1].strip(), int(found[2]), int(found[3]) if found[3] else None
    if start < 1 or (end is not None and end < start) or not contig:
        raise SourceError(f"region is out of range: {text!r}")
    return contig, start - 1, None if end is None else end - 1


def regions(texts: list[str] | str) -> list[tuple[str, int, int | None]]:
    parts = re.findall(r"\([^()]*\)", texts) if isinstance(texts, str) else texts
    if not parts:
        raise SourceError("no region given")
    return [region(p) for p in parts]


def open_text(path: str):
    """A text file, unpacked if its name ends in .gz or .gzip (several members are read one after another)."""
    if path.endswith((".gz", ".gzip")):
        with open(path, "rb") as raw:
            if raw.read(2) != b"\x1f\x8b":
                raise SourceError(f"{path} is not gzip data")
        return gzip.open(path, "rt")
    return open(path)


def repeat_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(contig, start, stop, tr_id, motif_len) of a catalog file; broken lines are errors, or dropped if not strict."""
    parsed = load_catalog(spark.read.text(path).withColumnRenamed("value", "line"), "line", ())
    if strict:
        failed = F.raise_error(F.concat(F.lit("catalog line does not load: "), F.col("reason")))
        parsed = parsed.withColumn("tr_id", F.when(F.col("reason").isNotNull(), failed.cast("string")).otherwise(F.col("tr_id")))
    kept = parsed if strict else parsed.filter(F.col("reason").isNull())
    return kept.select(F.col("chrom").alias("contig"), F.col("start_pos").alias("start"), F.col("end_pos").alias("stop"), "tr_id", "motif_len")
