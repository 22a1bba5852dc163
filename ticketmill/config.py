"""Typed settings of the jobs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PrepConfig:
    """How raw tickets become segmented, filtered and split records."""

    id_col: str = "doc_id"
    group_col: str = "group"
    text_col: str = "orgtext"
    mode: str = "finest"  # "finest": all dictionary words; "longest": non-overlapping
    keep_punctuation: bool = False
    mod: int = 300  # every mod-th row is held out


@dataclass(frozen=True)
class ForestParams:
    """Random-forest settings; the defaults are the full-size text workload."""

    num_trees: int = 200
    max_depth: int = 30
    max_bins: int = 70
    feature_subset: str = "auto"
    impurity: str = "gini"
    min_instances: int = 1
    min_info_gain: float = 0.0
    cache_node_ids: bool = False
    checkpoint_interval: int = 10
    seed: int = 1234
    max_memory_mb: int = 256

    def __post_init__(self):
        if not 0 <= self.max_depth <= 30:
            raise ValueError("max_depth must lie in 0..30")


@dataclass(frozen=True)
class TrainConfig:
    job_id: str
    model_dir: str
    output_dir: str
    num_features: int = 6900
    num_classes: int | None = None  # checked against the data when given
    fit_partitions: int | None = None  # fixed row placement for repeatable trees
    forest: ForestParams = field(default_factory=ForestParams)

    @property
    def model_path(self) -> str:
        return f"{self.model_dir}/job_id={self.job_id}"


@dataclass(frozen=True)
class ScoreConfig:
    job_id: str
    model_path: str
    output_dir: str
