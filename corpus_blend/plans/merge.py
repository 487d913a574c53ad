"""The merge job: read, standardize, combine, clean, order, split, report, write.

A first pass over the sources writes what every later step needs to know of a
row but its text (place, length, blank flags, content hash, roles) to the shared
folder, places as numbers of one width (see ``places``), so that the first of equal
rows is a plain minimum. Counting, deduplicating, splitting and reporting work on that
narrow table alone. A second pass takes the text straight to its place in the final
order and writes it: read twice, exchanged once, written once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpus_blend.functions.chat import (
    CHATML,
    PREFERENCE,
    PREFERENCE_FIELDS,
    row_hash,
    row_is_blank,
    row_length,
    row_preview,
)
from corpus_blend.functions.keys import FILE, POSITION, ROW, SRC, hash_number, key_text, not_after
from corpus_blend.operators.combine import concatenate
from corpus_blend.operators.dedupe import EXAMPLES, first_dropped
from corpus_blend.operators.detect import detect_format
from corpus_blend.operators.filters import inject_system_prompt, length_bounds
from corpus_blend.operators.interleave import pick_rows, place_rows, plan_picks, repositioned
from corpus_blend.operators.places import places_of
from corpus_blend.operators.report import (
    MERGED_EMPTY_RATE,
    SOURCE_EMPTY_RATE,
    histogram_of,
    inspect_source,
    profile_source,
    quality_of,
    source_counts,
)
from corpus_blend.operators.select import hash_slot, split_condition
from corpus_blend.operators.standardize import PROVENANCE, to_target
from corpus_blend.plans.spec import MergeSpec, OutputSpec
from corpus_blend.sinks.files import check_save_path, publish, save, saved_files, write_card, write_rows
from corpus_blend.sources.load import load_source, read_source
from corpus_blend.staging import one_run, stage

CHARS_PER_PARTITION = 256_000_000
FEWEST_CHARS = 8_000_000  # less than this is not worth a task of its own
MOST_PARTITIONS = 50_000  # beyond, partitions grow: their sort spills, more blocks would not fit
ROWS_PER_SHUFFLE_TASK = 5_000_000
COPIED_CHARS = "_copies * _length"
HOT_COPIES = 1_000
HOT_SETS = 50_000  # sets above total / HOT_SETS rows or characters: not more than twice as many
ROLES_SHOWN = 1_000  # the most frequent ones; the role table's files hold all


def inspect_sources(spark: SparkSession, spec: MergeSpec, count: bool = True, profile: bool = False) -> DataFrame:
    """One row per source: label, layout, rows, columns, sample. Nothing is merged.

    Rows come from the footers of Parquet files; others are read to be counted, unless ``count`` is
    off. With ``profile`` whole sources are read for mean length, missing and empty values and roles.
    """
    rows = []
    for s in spec.sources:
        limited = s.max_samples or s.sample_fraction
        found = load_source(spark, s) if limited else read_source(spark, s, settle=bool(s.strict_first_row))
        row = inspect_source(found, s.label, s.format, s.strict_first_row, count)
        if profile:
            known = profile_source(found, s.label, s.format, s.columns).drop("format", "n_rows")
            row = row.join(known, "source")  # one row each
        rows.append(row)
    return reduce(DataFrame.unionByName, rows)


def target_columns(target: str) -> list[str]:
    shape = {CHATML: ["messages"], PREFERENCE: list(PREFERENCE_FIELDS)}.get(target, ["text"])
    return [*shape, *PROVENANCE]


def _standardized(spark: SparkSession, spec: MergeSpec) -> tuple[list[DataFrame], list[str]]:
    frames, formats = [], []
    for s in spec.sources:
        rows = load_source(spark, s)
        found = detect_format(rows, s.format, s.strict_first_row)
        formats.append(found)
        frames.append(
            to_target(
                rows,
                found,
                spec.output.target_format,
                s.label,
                s.split,
                s.columns,
                json_content=s.json_content,
                case_insensitive=s.case_insensitive,
            )
        )
    return frames, formats


def measured(merged: DataFrame, out: OutputSpec) -> DataFrame:
    """Rows with the system prompt in place and the numbers later steps need.

    These are all per row, so they may be taken before rows are interleaved.
    """
    target = out.target_format
    rows = merged.withColumn("_blank_source", row_is_blank(target))
    if target == CHATML:
        rows = inject_system_prompt(rows, out.system_prompt)
        rows = rows.withColumn("_roles", F.transform("messages", lambda m: m.getField("role")))
    return rows.withColumns(
        {
            "_length": row_length(target),
            "_blank": row_is_blank(target),
            "_hash": F.unhex(row_hash(target, out.normalize_dedupe, out.strict_dedupe)),
        }
    )


def _fit_shuffles(spark: SparkSession, rows: int) -> None:
    """Raise the session's shuffle partitions where the narrow rows of this job need more."""
    name = "spark.sql.shuffle.partitions"
    needed = min(MOST_PARTITIONS, math.ceil(rows / ROWS_PER_SHUFFLE_TASK))
    if needed > int(spark.conf.get(name)):
        spark.conf.set(name, needed)


class Blend:
    """A merge worked out up to its final rows: narrow tables first, text on demand."""

    def __init__(self, spark: SparkSession, spec: MergeSpec):
        self.spark, self.spec, self.out = spark, spec, spec.output
        out = self.out
        frames, self.formats = _standardized(spark, spec)
        self.rows = measured(concatenate(frames), out)
        if out.stage_text:
            self.rows = stage(self.rows, "standardized")
        self.kept = length_bounds(F.col("_length"), out.min_length, out.max_length)
        roles = ["_roles"] if out.target_format == CHATML else []
        facts = ["_hash", "_length", "_blank", "_blank_source", *roles]
        self.places = places_of(self.rows)
        self.facts = stage(self.places.pack(self.rows.select(*POSITION, *facts)), "facts")
        narrow = self.facts.drop("_blank_source")
        self.sources = self._source_report()
        lengths = {i: s["rows"] for i, s in enumerate(self.sources) if s["rows"]}
        self.rows_before = sum(lengths.values())
        _fit_shuffles(spark, self.rows_before)
        self.picks = None
        if out.mode == "interleave":
            self.indexed = self.places.indexed(narrow)
            self.picks = plan_picks(
                spark, lengths, out.probabilities, out.seed, out.stopping_strategy
            )
            self.rows_before = sum(self.picks.counts.values())
            # deduplicating keeps no second copy of a row, so none needs to be made
            self.copies = 1 if out.dedupe else None
            narrow = place_rows(self.indexed, self.picks, self.copies)
        else:
            narrow = narrow.withColumn("_place", F.col("_at"))
        self.narrow = narrow.where(self.kept)
        self.rows_after = self._rows_after()
        self.survivors = self._survivors()
        totals = self.survivors.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("_length"), F.lit(0)).alias("chars"),
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("copies"),
            F.coalesce(F.max("_copies"), F.lit(0)).alias("most_copies"),
            F.coalesce(F.sum(F.expr(COPIED_CHARS)), F.lit(0)).alias("copied"),
            F.coalesce(F.max(F.expr(COPIED_CHARS)), F.lit(0)).alias("most_copied"),
        ).first()
        self.n_final, self.n_chars, self.n_copies, self.most_copies, self.copied, self.most_copied = totals
        self.in_test = split_condition(
            self._identified(self.survivors), out.train_test_split, out.seed, "_id"
        )

    def _identified(self, rows: DataFrame) -> DataFrame:
        """With the text that random choices hash: the content's hash, or the position where
        equal rows stay."""
        if self.out.dedupe:
            return rows.withColumn("_id", F.lower(F.hex("_hash")))
        if "_place" in rows.columns and self.picks is not None:
            return rows.withColumn("_id", F.concat_ws(":", F.lit("0"), F.lit(""), F.col("_place").cast("string")))
        rows = self.places.unpack(rows) if FILE not in rows.columns else rows
        return rows.withColumn("_id", key_text(POSITION))

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """With the label of each row's source, which narrow rows don't carry."""
        label = F.lit(None).cast("string")
        for i, source in enumerate(self.spec.sources):
            label = F.when(F.col(SRC) == i, F.lit(source.label)).otherwise(label)
        return rows.withColumn("source_dataset", label)

    def _source_report(self) -> list[dict]:
        counted = quality_of(
            self.facts, F.col("_blank_source"), SRC, SOURCE_EMPTY_RATE
        ).collect()  # one row per source of the configuration
        found = {r[SRC]: r for r in counted}
        report = []
        for i, (source, fmt) in enumerate(zip(self.spec.sources, self.formats)):
            r = found.get(i)
            quality = {
                "sample_size": r["sample_size"] if r else 0,
                "empty_rows": r["empty_rows"] if r else 0,
                "empty_rate": r["empty_rate"] if r else 0.0,
                "flagged": bool(r and r["flagged"]),
            }
            report.append(
                {
                    "source": source.label,
                    "format": fmt,
                    "rows": quality["sample_size"],
                    "quality": quality,
                }
            )
        return report

    def _rows_after(self) -> int:
        """Rows within the length bounds; of interleaved rows, every copy counts."""
        if self.out.min_length is None and self.out.max_length is None:
            return self.rows_before
        if self.picks is None or not self.out.dedupe:
            return self.narrow.count()
        copies = F.lit(0)
        for source, n in self.picks.counts.items():
            more = F.floor((F.lit(n - 1) - F.col("_index")) / self.sources[source]["rows"])
            used = (F.col(SRC) == source) & (F.col("_index") < n)
            copies = F.when(used, more + 1).otherwise(copies)
        within = self.indexed.where(self.kept)
        return within.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]

    def _survivors(self) -> DataFrame:
        """What is known of each final row but its text; ``_copies`` counts equal rows.

        All that is kept of the first of equal rows is of fixed width, so it is found by hashing.
        """
        if not self.out.dedupe:
            return stage(self.narrow.withColumn("_copies", F.lit(1).cast("bigint")), "survivors")
        kept = (SRC, "_no", "_at", "_length", "_blank")
        first = self.narrow.groupBy("_hash").agg(
            F.count("*").alias("_copies"),
            F.min("_place").alias("_place"),
            *(F.min_by(c, "_place").alias(c) for c in kept),
        )
        return stage(first, "survivors")

    def duplicate_examples(self) -> list[dict]:
        """The first dropped rows: where they came from and how they begin."""
        if not self.out.dedupe or self.rows_after == self.n_final:
            return []
        narrow = self.narrow
        if self.picks is not None:
            narrow = place_rows(self.indexed, self.picks, EXAMPLES + 1).where(self.kept)
        keys = narrow.select(SRC, "_no", "_at", "_place", "_hash")
        # EXAMPLES rows; as literals, their positions tell the scans which files to skip
        dropped = self.places.unpack(first_dropped(keys, "_hash", "_place")).orderBy("_place").collect()
        origins = [tuple(r[c] for c in POSITION) for r in dropped]
        here = [
            reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(POSITION, origin)])
            for origin in set(origins)
        ]
        shown = self.rows.where(reduce(lambda a, b: a | b, here)).select(
            *POSITION, "source_dataset", row_preview(self.out.target_format).alias("preview")
        )
        texts = {(r[SRC], r[FILE], r[ROW]): r for r in shown.collect()}
        return [
            {"source": texts[o]["source_dataset"], "preview": texts[o]["preview"]} for o in origins
        ]

    def partitions(self) -> int:
        """Output tasks, by the amount of text rather than by a fixed number."""
        whole = math.ceil(self.n_chars / CHARS_PER_PARTITION)
        cores = self.spark.sparkContext.defaultParallelism
        busy = min(cores, math.ceil(self.n_chars / FEWEST_CHARS))
        return max(1, min(whole, MOST_PARTITIONS), busy)

    def _without_hot_copies(self, rows: DataFrame) -> DataFrame:
        """Drop the repeats of very frequent rows before they are all sent to one task."""
        limit = max(HOT_COPIES, self.n_copies // HOT_SETS)
        heavy = max(CHARS_PER_PARTITION // 4, self.copied // HOT_SETS)
        if self.most_copies <= limit and self.most_copied <= heavy:
            return rows
        # more than total / HOT_SETS copies or characters each: at most twice HOT_SETS such rows
        hot = self.survivors.where((F.col("_copies") > limit) | (F.expr(COPIED_CHARS) > heavy))
        hot = self.places.unpack(hot).select("_hash", F.struct(*POSITION).alias("_first"))
        marked = rows.join(F.broadcast(hot), "_hash", "left")
        return marked.where(F.col("_first").isNull() | (F.col("_first") == F.struct(*POSITION)))

    def _in_slots(self, rows: DataFrame, partitions: int) -> DataFrame:
        """Rows with their split, sent to the task that holds their range of the final order."""
        number = hash_number(self.out.seed, F.col("_id"))
        rows = self._identified(rows).withColumn("_order", number)
        rows = rows.withColumn("split", self._split())
        rows = rows.withColumn("_slot", hash_slot(F.col("_order"), partitions))
        return rows.repartitionById(partitions, F.col("_slot"))

    def final(self, partitions: int | None = None) -> DataFrame:
        """The final rows with their split, in final order."""
        out = self.out
        columns = [*target_columns(out.target_format), "split"]
        partitions = partitions or self.partitions()
        if out.shuffle and out.dedupe:
            return self._first_in_slots(partitions).select(*columns)
        rows = self._text_rows()
        if out.shuffle:
            placed = self._in_slots(rows, partitions)
            return placed.sortWithinPartitions("split", "_order", *POSITION).select(*columns)
        if out.dedupe:
            same = Window.partitionBy("_hash").orderBy(*POSITION)
            rows = rows.withColumn("_rank", F.row_number().over(same)).where("_rank = 1")
        rows = self._identified(rows).withColumn("split", self._split())
        placed = rows.repartitionByRange(partitions, *POSITION)
        return placed.sortWithinPartitions("split", *POSITION).select(*columns)

    def _first_in_slots(self, partitions: int) -> DataFrame:
        """Shuffled and deduplicated in one exchange of the text: equal rows share a slot, so
        the exchange also serves the window, and its sort is the order wanted."""
        rows = self._without_hot_copies(self.rows.where(self.kept & self._drawn_from()))
        same = Window.partitionBy("split", "_slot", "_order", "_hash")
        if self.picks is None:
            ranked = self._in_slots(rows, partitions).withColumn(
                "_rank", F.row_number().over(same.orderBy(*POSITION))
            )
            return ranked.where("_rank = 1")
        # which row comes first depends on the draws: the narrow table tells, as rows of its own
        rows = rows.withColumn("_origin", F.struct(*POSITION))
        marks = stage(self.places.unpack(self.survivors).select("_hash", F.struct(*POSITION).alias("_keep")), "marks")
        both = self._in_slots(rows.unionByName(marks, allowMissingColumns=True), partitions)
        marked = both.withColumn("_keep", F.first("_keep").over(same.orderBy("_origin")))
        return marked.where(F.col("_origin") == F.col("_keep"))

    def _drawn_from(self) -> Column:
        """Rows the draws can have reached: of a source left early, those up to a position."""
        counts = self.picks.counts if self.picks else {}
        left_early = {s: n for s, n in counts.items() if n < self.sources[s]["rows"]}
        reached = F.lit(True)
        if not left_early:
            return reached
        number = F.lit(None)
        for s, n in left_early.items():
            number = F.when(F.col(SRC) == s, n - 1).otherwise(number)
        # one row per source
        last = self.places.unpack(self.indexed.where(F.col("_index") == number)).select(*POSITION).collect()
        ends = {r[SRC]: not_after([FILE, ROW], [r[FILE], r[ROW]]) for r in last}
        for s in left_early:
            reached = F.when(F.col(SRC) == s, ends.get(s, F.lit(False))).otherwise(reached)
        return reached

    def _text_rows(self) -> DataFrame:
        """Rows with their text at their place in the merged order."""
        if self.picks is None:
            return self.rows.where(self.kept)
        rows = self.rows.where(self._drawn_from() & self.kept)
        if self.places.packed and self.places.without_gaps:
            return pick_rows(self.places.indexed(self.places.pack(rows)), self.picks, self.copies)
        planned = self.places.unpack(self.narrow.select(SRC, "_no", "_at", "_index", "_place"))
        placed = rows.join(planned.select(*POSITION, "_index", "_place"), list(POSITION))
        return repositioned(placed, F.col("_place"))

    def _split(self) -> Column:
        if self.in_test is None:
            return F.lit("train")
        return F.when(self.in_test, "test").otherwise("train")

    def splits(self) -> dict[str, int]:
        chosen = self._identified(self.survivors).withColumn("split", self._split())
        counts = {r["split"]: r["count"] for r in chosen.groupBy("split").count().collect()}
        names = ["train"] if self.in_test is None else ["train", "test"]
        return {name: counts.get(name, 0) for name in names}

    def counters(self) -> dict[str, int]:
        return {
            "rows_before_filters": self.rows_before,
            "rows_after_filters": self.rows_after,
            "duplicates_removed": self.rows_after - self.n_final,
            "final_rows": self.n_final,
        }

    def kept_rows(self) -> list[int]:
        """Final rows of each source of the configuration, two of which may have one label."""
        found = {r[SRC]: r["count"] for r in self.survivors.groupBy(SRC).count().collect()}
        return [found.get(i, 0) for i in range(len(self.sources))]

    def statistics(self) -> dict[str, DataFrame]:
        """Composition tables of the final rows, from the narrow table."""
        tables = {
            "quality": quality_of(self.survivors, F.col("_blank"), None, MERGED_EMPTY_RATE),
            "source_counts": source_counts(self._labelled(self.survivors)),
            "lengths": histogram_of(self.survivors, F.col("_length")),
        }
        if self.out.target_format == CHATML:
            spoken = self.survivors
            if self.out.dedupe:  # a row that stays is the only one of its number
                spoken = self.facts.select("_at", "_roles").join(spoken.select("_at"), "_at", "left_semi")
            tables["role_counts"] = (
                spoken.select(F.explode("_roles").alias("role"))
                .groupBy("role")
                .agg(F.count("*").alias("n_messages"))
            )
        return tables


def run_merge(spark: SparkSession, spec: MergeSpec) -> dict:
    """Run a merge to its files; returns a summary of counts and locations.

    What is staged on the way is deleted at the end. Rows written are counted as they are written: if
    they are not as many as were planned, a source changed meanwhile, and the merge fails.
    """
    check_save_path(spark, spec)
    with one_run(spark):
        return _merge(spark, spec)


def _merge(spark: SparkSession, spec: MergeSpec) -> dict:
    blend = Blend(spark, spec)
    out = spec.output
    tables = blend.statistics()
    quality = tables["quality"].first().asDict()
    for source, kept in zip(blend.sources, blend.kept_rows()):
        source["rows_kept"] = kept
    summary = {
        "target_format": out.target_format,
        "mode": out.mode,
        "sources": blend.sources,
        **blend.counters(),
        "duplicate_examples": blend.duplicate_examples(),
        "splits": blend.splits(),
        "quality": quality,
        # one row per label and bin: small whatever the data
        "source_counts": {r[0]: r[1] for r in tables["source_counts"].collect()},
        "lengths": [r.asDict() for r in tables["lengths"].orderBy("bin").collect()],
        "sample_size": quality["sample_size"],
        "sampled": False,
        "system_prompt_injected": bool(out.system_prompt) and out.target_format == CHATML,
        "warnings": [
            f"{s['source']}: {s['quality']['empty_rows']} of {s['rows']} rows are blank after "
            "standardizing; check its column mapping"
            for s in blend.sources
            if s["quality"]["flagged"]
        ],
    }
    if "role_counts" in tables:
        _add_roles(spark, summary, tables["role_counts"], out.save_path)
    if out.mode == "interleave" and out.dedupe:
        summary["warnings"].append("rows repeated by interleaving are removed as duplicates")
    if out.save_path or out.push_to_hub:
        _write(spark, blend, summary)
    return summary


def _add_roles(spark: SparkSession, summary: dict, roles: DataFrame, save_path: str | None) -> None:
    """The summary lists the most frequent roles, by name where counts are equal, and says how many
    there are; all of them go to files."""
    roles = stage(roles, "roles")
    summary["n_roles"] = roles.count()
    listed = roles.orderBy(F.col("n_messages").desc(), "role").limit(ROLES_SHOWN).collect()
    summary["role_counts"] = {r["role"]: r["n_messages"] for r in listed}
    if save_path:
        summary["role_counts_path"] = write_rows(roles, f"{save_path.rstrip('/')}/role_counts")


def _write(spark: SparkSession, blend: Blend, summary: dict) -> None:
    out = blend.out
    written = Observation("written")
    final = blend.final().observe(written, F.count(F.lit(1)).alias("rows"))
    formats = sorted(set(out.save_formats if out.save_path else []), key=lambda f: f != "parquet")
    if len(formats) + bool(out.push_to_hub) > 1:
        # Exchanged once for all formats: one is written, the others are made from its files.
        if formats[0] == "parquet":
            saved = save(final, out.save_path, formats[:1])
            summary["save_files"] = saved
            final, formats = spark.read.schema(final.schema).parquet(saved["parquet"]), formats[1:]
        else:
            final = stage(final, "final")
    if formats:
        summary["save_files"] = summary.get("save_files", {}) | save(final, out.save_path, formats)
    if out.push_to_hub:
        publish(final, out.push_to_hub)
        summary["table"] = out.push_to_hub
    rows = written.get["rows"]
    if rows != blend.n_final:
        raise RuntimeError(f"{rows} rows were written, but {blend.n_final} were planned: a source has changed")
    if out.save_path:
        summary["save_path"] = out.save_path
        summary["files"] = saved_files(spark, summary["save_files"])
        if out.write_dataset_card:
            summary["dataset_card"] = write_card(spark, out.save_path, summary)
