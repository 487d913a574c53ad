"""Blend differently shaped text datasets into one table, as Spark DataFrame operators."""

from corpus_blend.operators.combine import concatenate
from corpus_blend.operators.dedupe import dedupe, duplicates
from corpus_blend.operators.detect import detect_format, fuzzy_mapping
from corpus_blend.operators.filters import filter_length, inject_system_prompt
from corpus_blend.operators.interleave import interleave, normalize_weights
from corpus_blend.operators.position import with_position
from corpus_blend.operators.report import (
    length_histogram,
    merge_statistics,
    profile_roles,
    profile_source,
    quality,
    role_counts,
    source_counts,
    source_report,
)
from corpus_blend.operators.select import (
    dense_index,
    first_rows,
    peek,
    sample_fraction,
    shuffle,
    split_train_test,
)
from corpus_blend.operators.standardize import standardize, to_target
from corpus_blend.plans.merge import inspect_sources, run_merge
from corpus_blend.plans.spec import MergeSpec, OutputSpec, SourceSpec, load_config
from corpus_blend.sinks.files import card_text, preview, publish, save
from corpus_blend.sources.load import load_file, load_source

__all__ = [
    "MergeSpec",
    "OutputSpec",
    "SourceSpec",
    "card_text",
    "concatenate",
    "dedupe",
    "dense_index",
    "detect_format",
    "duplicates",
    "filter_length",
    "first_rows",
    "fuzzy_mapping",
    "inject_system_prompt",
    "inspect_sources",
    "interleave",
    "length_histogram",
    "load_config",
    "load_file",
    "load_source",
    "merge_statistics",
    "normalize_weights",
    "peek",
    "preview",
    "profile_roles",
    "profile_source",
    "publish",
    "quality",
    "role_counts",
    "run_merge",
    "sample_fraction",
    "save",
    "shuffle",
    "source_counts",
    "source_report",
    "split_train_test",
    "standardize",
    "to_target",
    "with_position",
]
