"""Loading catalog lines that may be broken: every line either loads or comes out with the reason it does not.

Structure is judged by the Arrow CSV reader (its invalid-row callback collects lines with a wrong column count);
all fields are read as strings and then cast and checked as whole vectors, never line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they apply; the first one that holds is reported.
REASONS = (
    "bad_quote",
    "column_count",
    "bad_start",
    "bad_end",
    "bad_info",
    "duplicate_name",
    "missing_id",
    "missing_motifs",
    "bad_motif",
)
MAX_COORDINATE = 4294967295
_COLUMNS = ["chrom", "start", "stop", "info"]
_SEP = "[ \t\r]+"
_QUOTED = "^[ \t\r]*[^ \t\r\"]+[ \t\r]+[^ \t\r\"]+[ \t\r]+[^ \t\r\"]+[ \t\r]+\"[^\"]*\"(?:[ \t\r][^\"]*)?$"
CATALOG_SCHEMA = "chrom string, start_pos bigint, end_pos bigint, tr_id string, motifs array<string>, motif_len int, reason string"


def _mask(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.fill_null(values, False).to_numpy(zero_copy_only=False), dtype=bool)


def _free_control(lines: pa.Array) -> str:
    """A control character that no line holds, to stand for line feeds while the CSV reader runs."""
    for code in (*range(1, 9), *range(14, 32)):
        if not pc.any(pc.match_substring(lines, chr(code))).as_py():
            return chr(code)
    raise ValueError("the batch holds every control character")


def _structure(lines: pa.Array) -> tuple[np.ndarray, pa.Table, np.ndarray]:
    """Reason codes (-1: none yet), the fields of structurally valid lines, and the indexes of those lines."""
    n = len(lines)
    reason = np.full(n, -1, dtype=np.int8)
    feed = _free_control(lines)
    text = pc.replace_substring(pc.fill_null(lines, ""), "\n", feed)
    quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False)
    paired = _mask(pc.match_substring_regex(text, f"(?s){_QUOTED}"))
    reason[(quotes > 0) & ~paired] = 0
    plain = np.asarray(quotes == 0)
    flat = pc.replace_substring_regex(pc.replace_substring_regex(text, f"^{_SEP}|{_SEP}$", ""), _SEP, "\t")
    if paired.any():
        parts = pc.extract_regex(text, '(?s)^(?P<head>[^"]*)"(?P<info>[^"]*)"(?P<rest>[^"]*)$')
        tidy = [
            pc.replace_substring_regex(pc.replace_substring_regex(pc.struct_field(parts, k), f"^{_SEP}|{_SEP}$", ""), _SEP, "\t")
            for k in ("head", "rest")
        ]
        quoted = pc.binary_join_element_wise(tidy[0], '\t"', pc.struct_field(parts, "info"), '"', "")
        rest = pc.if_else(pc.equal(tidy[1], ""), "", pc.binary_join_element_wise("\t", tidy[1], ""))
        flat = pc.if_else(pa.array(paired), pc.binary_join_element_wise(quoted, rest, ""), flat)
    blank = _mask(pc.equal(flat, ""))
    reason[plain & blank] = 1
    kept = np.flatnonzero((reason < 0) & (plain | paired))
    if not len(kept):
        return reason, pa.table({c: pa.array([], pa.string()) for c in _COLUMNS}), kept
    rejected: list[int] = []

    def structural(row: pacsv.InvalidRow) -> str:
        rejected.append(row.number - 1)
        return "skip"

    body = ("\n".join(flat.take(pa.array(kept)).to_pylist()) + "\n").encode()
    read = pacsv.read_csv(
        pa.BufferReader(body),
        read_options=pacsv.ReadOptions(column_names=_COLUMNS, use_threads=False, block_size=max(len(body) + 1, 1 << 20)),
        parse_options=pacsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=False, ignore_empty_lines=False, invalid_row_handler=structural),
        convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in _COLUMNS}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    dropped = np.asarray(rejected, dtype=np.int64)
    reason[kept[dropped]] = 1
    fields = read.combine_chunks()
    fields = pa.table({c: pc.replace_substring(fields[c], feed, "\n") for c in _COLUMNS})
    return reason, fields, np.delete(kept, dropped)


def _coordinate(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    digits = pc.match_substring_regex(column, "^[0-9]+$")
    short = pc.replace_substring_regex(column, "^0+([0-9])", "\\1")
    sized = pc.and_(digits, pc.less_equal(pc.utf8_length(short), 10))
    value = pc.cast(pc.if_else(sized, short, None), pa.int64())
    good = pc.and_(sized, pc.less_equal(pc.fill_null(value, 0), MAX_COORDINATE))
    return value, ~_mask(good)


def _info(info: pa.ChunkedArray) -> tuple[dict[int, np.ndarray], list, list, np.ndarray]:
    """Masks by reason code, and id, motifs and shortest motif by line."""
    n = len(info)
    items = pc.split_pattern(info.combine_chunks() if isinstance(info, pa.ChunkedArray) else info, ";")
    parent = pc.list_parent_indices(items).to_numpy()
    flat = pc.list_flatten(items)
    pairs = pc.extract_regex(flat, "(?s)^(?P<name>[^=]+)=(?P<value>.+)$")
    bad = np.zeros(n, dtype=bool)
    bad[parent[~np.asarray(pc.is_valid(pairs).to_numpy(zero_copy_only=False), dtype=bool)]] = True
    name = pc.struct_field(pairs, "name")
    value = pc.struct_field(pairs, "value")
    code = name.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    both = parent.astype(np.int64) * (len(flat) + 2) + code + 1
    _, first, count = np.unique(both, return_index=True, return_counts=True)
    twice = np.zeros(n, dtype=bool)
    repeated = first[count > 1]
    twice[parent[repeated[code[repeated] >= 0]]] = True

    def pick(wanted: str) -> pa.Array:
        at = np.flatnonzero(_mask(pc.equal(name, wanted)))
        where = np.full(n, -1, dtype=np.int64)
        where[parent[at][::-1]] = at[::-1]
        return pc.take(value, pa.array(where, mask=where < 0))

    ident, motifs = pick("ID"), pick("MOTIFS")
    no_id, no_motifs = ~_mask(pc.is_valid(ident)), ~_mask(pc.is_valid(motifs))
    lists = pc.split_pattern(motifs, ",")
    lengths = pc.utf8_length(pc.list_flatten(lists)).to_numpy(zero_copy_only=False)
    owner = pc.list_parent_indices(lists).to_numpy()
    shortest = np.full(n, np.iinfo(np.int32).max, dtype=np.int64)
    np.minimum.at(shortest, owner, lengths)
    odd = np.zeros(n, dtype=bool)
    odd[owner[~_mask(pc.match_substring_regex(pc.list_flatten(lists), "^[ACGTNacgtn]+$"))]] = True
    return {4: bad, 5: twice, 6: no_id, 7: no_motifs, 8: odd}, ident, lists, shortest


def parse_catalog_lines(lines: pa.Array) -> pa.Table:
    """One row per line with the loaded fields (null where it does not load) and the reason (null where it does)."""
    n = len(lines)
    reason, fields, kept = _structure(lines.cast(pa.string()))
    start, bad_start = _coordinate(fields["start"])
    stop, bad_stop = _coordinate(fields["stop"])
    masks, ident, motifs, shortest = _info(fields["info"])
    own = np.full(len(kept), -1, dtype=np.int8)
    for code, mask in {2: bad_start, 3: bad_stop, **masks}.items():
        own[(own < 0) & mask] = code
    reason[kept] = own
    good = own < 0
    slot = np.full(n, -1, dtype=np.int64)
    slot[kept[good]] = np.flatnonzero(good)
    take = pa.array(slot, mask=slot < 0)
    names = pa.array(reason, mask=reason < 0)
    return pa.table(
        {
            "chrom": pc.take(fields["chrom"], take),
            "start_pos": pc.take(start, take),
            "end_pos": pc.take(stop, take),
            "tr_id": pc.take(ident, take),
            "motifs": pc.take(motifs, take),
            "motif_len": pc.take(pa.array(shortest), take).cast(pa.int32(), safe=False),
            "reason": pc.take(pa.array(REASONS), names),
        }
    )


def load_catalog(df: DataFrame, line: str = "raw_line", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Parse a column of raw catalog lines; the columns of ``keep`` pass through.

    The result has one row per input row: ``reason`` is null for a loaded line, else the first of ``REASONS``
    that applies, with all loaded fields null.  Null and blank lines are ``column_count``; repeated lines are
    judged one by one; very long lines are whole.  Other columns of ``df``, also ones named like the loaded
    fields, are dropped unless kept.  No shuffle: one narrow stage over two columns of the scan.
    """
    clash = set(keep) & {c.split()[0] for c in CATALOG_SCHEMA.split(", ")}
    if clash:
        raise ValueError(f"kept columns are named like loaded fields: {sorted(clash)}")
    source = df.select(*keep, F.col(line).cast("string").alias("_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = parse_catalog_lines(batch.column(len(keep)))
            columns = [batch.column(i) for i in range(len(keep))]
            out = pa.table([*columns, *parsed.columns], names=[*keep, *parsed.column_names])
            yield from out.combine_chunks().to_batches()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*kept, CATALOG_SCHEMA]))


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull())
