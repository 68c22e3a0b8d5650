"""Merge settings: one frozen value, checked on construction, readable from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

# Fixed values that results depend on.
EPSILON = 1e-9
SV_CLASSES = ("INS", "DEL", "INV", "DUP", "CNV", "BND")
CONSTRAINTS = ("none", "bbox_diameter", "clique", "centroid")


class ConfigError(ValueError):
    """A setting is unknown or out of its domain."""


@dataclass(frozen=True)
class MergeConfig:
    """Settings of a merge.  Settings that only steer a single machine's threads and buffers are checked and have no effect."""

    max_dist: float = 1000.0
    min_dist: float = 100.0
    max_dist_linear: float = 0.5
    disable_linear_threshold: bool = False
    min_sequence_similarity: float = 0.8
    min_size_similarity: float = 0.0
    min_reciprocal_overlap: float = 0.0
    knn_search_k: int = 4
    no_shard: bool = False
    min_shard_size: int = 0
    allow_intrasample: bool = False
    no_mutual_distance: bool = False
    merge_constraint: str = "none"
    min_supp: int = 1
    keep_monomorphic: bool = False
    filter_tr_contained: bool = False
    tr_span_query_slop: int = 0
    tr_min_span_containment: int = 800_000
    tr_min_span_overlap_bp: int = 1
    tr_ins_max_dist: int = 0
    tr_max_dist: float = 4000.0
    tr_min_sequence_similarity: float = 0.6
    tr_min_recip_overlap: float = 0.0
    svtype: tuple[str, ...] = SV_CLASSES
    contig: tuple[str, ...] = ()
    target_positions: tuple[str, ...] = ()
    sort_output: bool = False
    sort_max_mem: str = "768M"
    sort_max_open_files: int = 64
    sort_merge_fan_in: int = 32
    threads: int = 1
    io_threads: int = 2
    force_single: bool = False
    no_version: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "merge_constraint", self.merge_constraint.replace("-", "_").replace("bbox_diam", "bbox_diam"))
        object.__setattr__(self, "svtype", selected_classes(self.svtype))
        checks = {
            "max_dist": self.max_dist >= 0,
            "tr_max_dist": self.tr_max_dist >= 0,
            "min_dist": self.min_dist >= -1,
            "knn_search_k": 1 <= self.knn_search_k <= 1024,
            "min_shard_size": self.min_shard_size >= 0,
            "merge_constraint": self.merge_constraint in CONSTRAINTS,
            "min_supp": self.min_supp >= 1,
            "threads": self.threads >= 1,
            "io_threads": self.io_threads >= 1,
            "sort_max_open_files": self.sort_max_open_files >= 1,
            "sort_merge_fan_in": 1 <= self.sort_merge_fan_in <= self.sort_max_open_files,
            "tr_min_span_containment": 0 <= self.tr_min_span_containment <= 1_000_000,
        }
        for name in ("min_sequence_similarity", "min_size_similarity", "min_reciprocal_overlap", "tr_min_sequence_similarity", "tr_min_recip_overlap"):
            checks[name] = 0 <= getattr(self, name) <= 1
        for name, good in checks.items():
            if not good:
                raise ConfigError(f"{name} is out of range: {getattr(self, name)!r}")
        byte_size(self.sort_max_mem)

    @property
    def linear(self) -> bool:
        return self.max_dist_linear > 0 and not self.disable_linear_threshold


def selected_classes(names: tuple[str, ...] | list[str] | str) -> tuple[str, ...]:
    """The union of the named classes in fixed order, in any letter case; ALL stands for all six."""
    given = {n.strip().upper() for n in (names.split(",") if isinstance(names, str) else names)}
    unknown = given - set(SV_CLASSES) - {"ALL"}
    if unknown or not given:
        raise ConfigError(f"unknown classes: {sorted(unknown)}")
    return SV_CLASSES if "ALL" in given else tuple(c for c in SV_CLASSES if c in given)


def byte_size(text: str) -> int:
    """Bytes named by a number with an optional decimal unit k, m or g."""
    units = {"k": 10**3, "m": 10**6, "g": 10**9}
    tidy = text.strip().lower().removesuffix("b")
    factor = units.get(tidy[-1:], 1)
    try:
        value = float(tidy[:-1] if tidy[-1:] in units else tidy) * factor
    except ValueError as error:
        raise ConfigError(f"not a size: {text!r}") from error
    if not 0 < value < float("inf"):
        raise ConfigError(f"not a positive size: {text!r}")
    return int(value)


def from_toml(path: str | Path, **overrides: object) -> MergeConfig:
    """Settings of a TOML file (a [merge] table or top level); unknown keys are errors, ``overrides`` win."""
    with open(path, "rb") as file:
        content = tomllib.load(file)
    content = content.get("merge", content)
    known = {f.name for f in fields(MergeConfig)}
    unknown = set(content) - known
    if unknown:
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    tidy = {k: tuple(v) if isinstance(v, list) else v for k, v in content.items()}  # paths aren't settings: they come from the command line
    return replace(MergeConfig(**tidy), **overrides)


#: The stricter preset.
BALANCED = MergeConfig(
    max_dist_linear=0.4, min_dist=100, max_dist=850, min_sequence_similarity=0.85, min_size_similarity=0.2, min_reciprocal_overlap=0.1,
    knn_search_k=8, merge_constraint="clique",
)
