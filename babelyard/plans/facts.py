"""Facts of projects, one row each: package (JSON text), config text, and flags of what exists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelyard.functions.text import locale_dir, locale_label, major_version

FACTS = (
    "project string, package string, next_config string, flag string, has_app boolean, has_pages boolean, "
    "has_layout boolean, has_pages_app boolean, files array<string>"
)


def dependency(name: str) -> Column:
    """The version of a dependency; one for development counts over the other."""
    at = lambda group: F.expr(f"""try_variant_get(try_parse_json(package), '$.{group}["{name}"]', 'string')""")
    return F.coalesce(at("devDependencies"), at("dependencies"))


def adapter(projects: DataFrame) -> DataFrame:
    """project, name, reason, error: the translation adapter by the first rule that decides."""
    intl, i18n = dependency("next-intl").isNotNull(), dependency("next-i18next").isNotNull()
    app, pages, flag = F.col("has_app"), F.col("has_pages"), F.col("flag")
    rules = (
        (flag == "pages-router", "next-i18next", "flag", None),
        (flag == "app-router", "next-intl", "flag", None),
        (flag.isNotNull() & (flag != ""), None, None, "Invalid --adapter value"),
        (intl & ~i18n, "next-intl", "dependency", None),
        (i18n & ~intl, "next-i18next", "dependency", None),
        (intl & i18n, None, None, "Ambiguous project: both packages are dependencies"),
        (app & ~pages, "next-intl", "app directory", None),
        (pages & ~app, "next-i18next", "pages directory", None),
        (app & pages, None, None, "Ambiguous project: both app/ and pages/ exist"),
        (F.coalesce(F.col("next_config"), F.lit("")).rlike(r"appDir\s*:\s*true"), "next-intl", "appDir in configuration", None),
        (F.lit(True), None, None, "Detection failed or is ambiguous"),
    )
    text = lambda v: F.lit(v).cast("string")
    value = lambda r: F.struct(text(r[1]).alias("name"), text(r[2]).alias("reason"), text(r[3]).alias("error"))
    verdict = reduce(lambda out, r: out.when(F.coalesce(r[0], F.lit(False)), value(r)), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(False)), value(rules[0])))
    return projects.select("project", verdict.alias("v")).select("project", "v.*")


def environment(projects: DataFrame) -> DataFrame:
    """project, status, reason, i18next, react_i18next, next_note."""
    react, types, nxt = (major_version(dependency(n)) for n in ("react", "typescript", "next"))
    status = F.when(react < 16, "unsupported").when(types < 5, "legacy").otherwise("supported")
    rows = projects.withColumn("status", status)
    legacy, bad = F.col("status") == "legacy", F.col("status") == "unsupported"
    return rows.select(
        "project", "status",
        F.when(bad, F.concat(F.lit("React "), dependency("react"), F.lit(" has no hooks"))).alias("reason"),
        F.when(legacy, "^22.5.1").when(~bad, "latest").alias("i18next"),
        F.when(legacy, "^12.1.1").when(~bad, "latest").alias("react_i18next"),
        F.when(~bad & (nxt < 13), F.concat(F.lit("Next.js "), dependency("next"), F.lit(": pages router"))).alias("next_note"),
    )


def _first_file(*candidates: str) -> Column:
    return F.get(F.filter(F.array(*(F.lit(c) for c in candidates)), lambda c: F.array_contains("files", c)), F.lit(0))


def tailwind(projects: DataFrame, css_entries: tuple[str, ...] = ("src/index.css", "src/app/globals.css", "app/globals.css", "src/styles/globals.css", "styles/globals.css")) -> DataFrame:
    """project, has_tailwind, version, config_path, css_entry_path, is_logical_v2."""
    at = lambda group: F.expr(f"try_variant_get(try_parse_json(ltrim('﻿', package)), '$.{group}.tailwindcss', 'string')")
    found = F.nullif(F.regexp_extract(F.coalesce(at("dependencies"), at("devDependencies")), r"([0-9]+)", 1), F.lit("")).try_cast("int")
    version = F.when(found.isin(2, 3, 4), found)
    rows = projects.withColumn("version", version)
    return rows.select(
        "project", F.col("version").isNotNull().alias("has_tailwind"), "version",
        F.when(F.col("version").isin(2, 3), _first_file("tailwind.config.js", "tailwind.config.ts")).alias("config_path"),
        F.when(F.col("version") == 4, _first_file(*css_entries)).alias("css_entry_path"),
        dependency("tailwindcss-logical").isNotNull().alias("is_logical_v2"),
    )


def frameworks(projects: DataFrame) -> DataFrame:
    """project, is_next: a configuration, a dependency, and a layout or an application file."""
    config = F.array_contains("files", "next.config.js") | F.array_contains("files", "next.config.mjs")
    return projects.select("project", (config & dependency("next").isNotNull() & (F.col("has_layout") | F.col("has_pages_app"))).alias("is_next"))


def lint_warning(files: DataFrame) -> DataFrame:
    """project, warn. files: project, path, content: linter settings that name a project without its root."""
    own = files.where(F.col("path").isin(".eslintrc", ".eslintrc.json", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.yaml", ".eslintrc.yml"))
    named = F.col("content").contains('"project"') | F.col("content").contains("'project'")
    return own.groupBy("project").agg(F.bool_or(named & ~F.col("content").contains("tsconfigRootDir")).alias("warn"))


def document_fallback(projects: DataFrame) -> DataFrame:
    """project, doc_path, fallback_dest. projects: pages_dir, has_pages_app, files."""
    held = [F.when(F.array_contains("files", F.concat_ws("/", "pages_dir", F.lit(c))), F.concat_ws("/", "pages_dir", F.lit(c))) for c in ("_document.tsx", "_document.jsx")]
    doc = F.when(F.col("pages_dir").isNotNull(), F.coalesce(*held))
    rows = projects.withColumn("doc_path", doc)
    dest = F.when(F.col("pages_dir").isNotNull() & F.col("doc_path").isNull() & F.col("has_pages_app"), F.concat_ws("/", "pages_dir", F.lit("_document.tsx")))
    return rows.select("project", "doc_path", dest.alias("fallback_dest"))


def locale_table(locales: DataFrame) -> DataFrame:
    """code, label, dir of every code."""
    return locales.select("code", locale_label(F.col("code")).alias("label"), locale_dir(F.col("code")).alias("dir"))


def language_arrays(files: DataFrame, languages: list[str]) -> DataFrame:
    """path, found: written-out lists of exactly these languages in this order; none for a single language, and none from the locales module."""
    if len(languages) < 2:
        return files.select("path", F.lit("").alias("found")).where("false")
    listed = r"\s*,\s*".join(f"""['"]{x}['"]""" for x in languages)
    own = files.where(~F.replace(F.col("path"), F.lit("\\"), F.lit("/")).contains("/i18n/locales."))
    return own.select("path", F.explode(F.regexp_extract_all("content", F.lit(rf"(\[\s*{listed}\s*\])"), F.lit(1))).alias("found"))
