"""Whole runs over a project's files, as plans of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelyard.functions.classes import rewrite_value
from babelyard.operators import audit, edits, extract, registry, sync
from babelyard.operators.rules import DEFAULT_RULES, Rule
from babelyard.operators.translate import Provider, run_translations
from babelyard.sources import files as sources


@dataclass
class Config:
    languages: list[str] = field(default_factory=lambda: ["en"])
    default_language: str = "en"
    coverage_threshold: float = 100.0
    data_files: list[str] = field(default_factory=list)
    v2_classes: bool = False


def class_report(files: DataFrame, v2: bool = False) -> DataFrame:
    """One row: files_modified, classes_replaced, dynamic (not rewritten), needs_mirror."""
    values = audit.read_class_values(files).withColumn("new", rewrite_value(F.col("value"), v2))
    changed = F.coalesce(F.col("new.replacements"), F.lit(0))
    return values.agg(
        F.count_distinct(F.when(changed > 0, F.col("doc"))).alias("files_modified"), F.coalesce(F.sum(changed), F.lit(0)).alias("classes_replaced"),
        F.count_if("dynamic").alias("dynamic"), F.count_if(F.coalesce(F.col("new.needs_mirror"), F.lit(False))).alias("needs_mirror"),
    )


def class_edits(files: DataFrame, v2: bool = False) -> DataFrame:
    values = audit.read_class_values(files).withColumn("new", rewrite_value(F.col("value"), v2))
    return values.where("new.replacements > 0").select(F.col("doc").alias("path"), "start", "end", F.col("new.value").alias("replacement"))


def audit_project(files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """doc, analyzer, score, n_findings of style sheets and components, by the given rules."""
    css, code = files.where("ext = '.css'"), files.where(F.col("ext").isin(*sources.SCRIPTS))
    sheets = audit.scores(css.select(F.col("path").alias("doc")), audit.css_findings(sources_css(css), rules), "css", rules=rules)
    parts = audit.scores(code.select(F.col("path").alias("doc")), audit.jsx_findings(code, rules), "jsx", rules=rules)
    return sheets.withColumn("analyzer", F.lit("css")).unionByName(parts.withColumn("analyzer", F.lit("jsx")))


def sources_css(files: DataFrame) -> DataFrame:
    from babelyard.sources.css import read_declarations

    return read_declarations(files)


def fix_styles(files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Style sheets and components with logical properties: path, content, n_edits. Style sheets follow the given rules."""
    css = audit.css_edits(sources_css(files.where("ext = '.css'")), rules)
    code = audit.read_style_edits(files.where(F.col("ext").isin(*sources.SCRIPTS)))
    return edits.edit_files(files.select("path", "content"), css.unionByName(code))


@dataclass
class Extracted:
    keyed: DataFrame
    messages: DataFrame
    files: DataFrame
    skipped: DataFrame


def extract_project(files: DataFrame, data: DataFrame | None = None, key_map: DataFrame | None = None) -> Extracted:
    """Keys, messages, rewritten files and skipped elements of component sources."""
    code = files.where(F.col("ext").isin(*sources.SCRIPTS))
    own = registry.registry(registry.data_leaves(data)) if data is not None else None
    keyed = extract.with_keys(extract.extract_units(code, own), key_map)
    written = extract.source_edits(keyed).unionByName(extract.read_import_edits(code, own))
    done = edits.edit_files(code.select("path", "content"), edits.first_of_each_range(written))
    return Extracted(keyed, extract.extracted_messages(keyed), done, keyed.where("kind = 'skipped'").select("path", "tag", "line", "reason"))


@dataclass
class Synced:
    messages: DataFrame
    report: DataFrame
    value_edits: DataFrame
    snapshot: DataFrame


def sync_project(files: DataFrame, config: Config, previous: DataFrame | None = None, migrate: bool = False, prune: bool = False, provider: Provider | None = None, targets: list[str] | None = None) -> Synced:
    """One run of the comparison: new keys, orphans, edited values, coverage; nothing is written."""
    default = config.default_language
    messages = sources.read_messages(files)
    locales = [r[0] for r in messages.select("locale").distinct().collect()]  # a project's locales
    code = sources.walk(files, "sync")
    leaves = registry.data_leaves(sources.data_files(files, config.data_files))
    valid = sync.valid_keys(extract.static_keys(code), registry.data_keys(leaves))
    snapshot = registry.data_paths(leaves)
    before = previous if previous is not None else snapshot.where("false")
    changed = sync.value_edits(before, snapshot)
    if migrate:
        messages = sync.migrate(messages, changed, default)
    delta = sync.new_keys(valid, messages, default)
    done = sync.write_back(messages, valid, default, prune)
    if provider is not None and targets:
        done = run_translations(done, targets, default, provider, delta)
    report = sync.reconcile(valid, messages, locales, default, config.coverage_threshold, prune)
    return Synced(done, report, changed, snapshot)
