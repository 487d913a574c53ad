"""What to blend: sources and output settings, from a dict, a YAML file or a JSON file."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field, fields

from corpus_blend.functions.chat import CHATML, check_target
from corpus_blend.operators.detect import validate_format
from corpus_blend.operators.interleave import ALL, check_stop, normalize_weights
from corpus_blend.operators.standardize import validate_columns

# Setting names and defaults of the configuration format.
MODES = ("concatenate", "interleave")
SAVE_FORMATS = ("jsonl", "csv", "parquet")
DEFAULT_SPLIT = "train"
DEFAULT_SEED = 42
DEFAULT_SAVE_PATH = "./merged_dataset"
UNNAMED = "unknown source"
IGNORED = {"eval_split"}  # exported configurations may hold it, and nothing ever read it


@dataclass
class SourceSpec:
    """One source: a catalog table (``repo_id``) or files (``local_path``)."""

    repo_id: str | None = None
    local_path: str | None = None
    config: str | None = None
    split: str = DEFAULT_SPLIT
    streaming: bool = False
    max_samples: int | None = None
    sample_fraction: float | None = None
    sample_seed: int = DEFAULT_SEED
    format: str | None = None
    columns: dict = field(default_factory=dict)
    # reading
    reader: str | None = None
    schema: str | None = None
    order_by: str | list[str] | None = None
    multi_line: bool = True
    json_content: bool = False
    case_insensitive: bool = False
    strict_first_row: bool = False

    def __post_init__(self) -> None:
        if not (self.repo_id or self.local_path):
            raise ValueError("a source needs repo_id (a table) or local_path (files)")
        self.format = validate_format(self.format)
        self.columns = validate_columns(self.columns)
        self.split = self.split or DEFAULT_SPLIT

    @property
    def label(self) -> str:
        return self.repo_id or self.local_path or UNNAMED


@dataclass
class OutputSpec:
    target_format: str = CHATML
    mode: str = "concatenate"
    probabilities: list[float] | None = None
    stopping_strategy: str = ALL
    system_prompt: str | None = None
    dedupe: bool = True
    normalize_dedupe: bool = False
    strict_dedupe: bool = False
    min_length: int | None = None
    max_length: int | None = None
    shuffle: bool = True
    seed: int = DEFAULT_SEED
    train_test_split: float | int | None = None
    save_path: str | None = DEFAULT_SAVE_PATH
    save_formats: list[str] = field(default_factory=lambda: ["jsonl"])
    write_dataset_card: bool = True
    push_to_hub: str | None = None  # here: the catalog table to publish as
    # keep the standardized text for the second pass; left open, only where hashing is slow
    stage_text: bool | None = None

    def __post_init__(self) -> None:
        check_target(self.target_format)
        check_stop(self.stopping_strategy)
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r} (use {' or '.join(MODES)})")
        if self.stage_text is None:
            self.stage_text = self.dedupe and self.normalize_dedupe
        self.save_formats = list(self.save_formats or ["jsonl"])
        wrong = [f for f in self.save_formats if f not in SAVE_FORMATS]
        if wrong:
            raise ValueError(f"unknown save formats {wrong} (use {', '.join(SAVE_FORMATS)})")


@dataclass
class MergeSpec:
    sources: list[SourceSpec]
    output: OutputSpec = field(default_factory=OutputSpec)

    def __post_init__(self) -> None:
        if not self.sources:
            raise ValueError("there is nothing to combine")
        weights = self.output.probabilities
        if self.output.mode == "interleave" and weights is not None:
            if len(weights) != len(self.sources):
                raise ValueError(
                    f"{len(self.sources)} sources need as many weights, not {len(weights)}"
                )
            normalize_weights(weights, self.output.stopping_strategy)

    @classmethod
    def from_dict(cls, config: dict) -> MergeSpec:
        sources = [SourceSpec(**_known(SourceSpec, entry)) for entry in config.get("datasets") or []]
        return cls(sources, OutputSpec(**_known(OutputSpec, config.get("output") or {})))


def _known(kind, settings: dict) -> dict:
    """Settings with a value; an empty one means its default, a misspelt one is an error."""
    names = {f.name for f in fields(kind)}
    if IGNORED & set(settings):
        warnings.warn(f"{', '.join(sorted(IGNORED & set(settings)))} has no effect", stacklevel=3)
        settings = {k: v for k, v in settings.items() if k not in IGNORED}
    wrong = sorted(set(settings) - names)
    if wrong:
        raise ValueError(f"unknown settings {', '.join(wrong)} (use {', '.join(sorted(names))})")
    return {k: v for k, v in settings.items() if v is not None and v != ""}


def load_config(path: str) -> MergeSpec:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return MergeSpec.from_dict(json.load(f))
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs PyYAML; a .json file works without") from error
        return MergeSpec.from_dict(yaml.safe_load(f))
