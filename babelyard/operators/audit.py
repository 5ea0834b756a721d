"""Audits: findings of documents, and their scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelyard.functions import lookups as L
from babelyard.functions.classes import directional_findings
from babelyard.functions.text import component_path
from babelyard.operators.rules import DEFAULT_RULES, Rule, all_fits, first_fit, points
from babelyard.sources.html import PARSE_ERROR as UNPARSED
from babelyard.sources import jsx
from babelyard.sources.slices import few

STRUCTURE = ("header", "nav", "main", "footer")
META = ("viewport", "description", "keywords", "author")


def penalties(spark: SparkSession, analyzer: str | None = None, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """analyzer, code, points, severity: a few dozen rows, and those of a user's rules."""
    rows = [p for p in points(rules) if analyzer in (None, p[0])]
    return spark.createDataFrame(rows, "analyzer string, code string, points int, severity string")


def with_points(findings: DataFrame, analyzer: str, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds points and severity; a code that is not in the table costs nothing."""
    own = penalties(findings.sparkSession, analyzer, rules).drop("analyzer")
    return findings.join(F.broadcast(own), "code", "left").withColumn("points", F.coalesce("points", F.lit(0)))


def scores(documents: DataFrame, findings: DataFrame, analyzer: str, key: str = "doc", rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """key, score, n_findings of every document: 100 less the points of its findings, 0 at least.

    Points are never negative, so one bound at the end is the same as one at each step, and sums
    are taken before rows are dealt out.
    """
    total = with_points(findings, analyzer, rules).groupBy(key).agg(F.sum("points").alias("lost"), F.count("*").alias("n_findings"))
    out = documents.select(key).join(total, key, "left")
    score = F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("int")
    return out.select(key, score.alias("score"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


# -- HTML --------------------------------------------------------------------


def _tag(html: Column, name: str) -> Column:
    return html.rlike(rf"(?i)<{name}[\s>/]")


def _html_attribute(html: Column, name: str) -> Column:
    """Whether the html element has the attribute with a value that is not empty."""
    return html.rlike(rf"""(?i)<html\b[^>]*\s{name}\s*=\s*(?:"[^"]+"|'[^']+'|[^\s"'>]+)""")


def html_checks(html: Column, is_main: bool = True, check_structure: bool = False, is_react: bool = False) -> list[tuple[str, Column]]:
    """(code, whether it is missing), by patterns over the text; tags inside comments and scripts count as there."""
    checks = []
    if (is_main or check_structure) and not is_react:
        checks += [(f"MISSING_{t.upper()}", ~_tag(html, t)) for t in ("header", "nav", "footer")]
    if is_main:
        checks.append(("MISSING_META_CHARSET", ~html.rlike(r"(?i)<meta\b[^>]*\bcharset\b")))
        checks += [
            (f"MISSING_META_{m.upper()}", ~html.rlike(rf"""(?i)<meta\b[^>]*\bname\s*=\s*["']?{m}["'\s/>]""")) for m in META
        ]
        there = html.rlike(r"(?i)<html[\s>]")
        checks += [(f"MISSING_{a.upper()}_ATTRIBUTE", there & ~_html_attribute(html, a)) for a in ("lang", "dir")]
    return checks


def html_findings(pages: DataFrame, key: str = "page_id", html: str = "html", **options) -> DataFrame:
    """key, code: one row for each finding of a page, from the page's own row."""
    checks = html_checks(F.coalesce(F.col(html), F.lit("")), **options)
    codes = F.filter(F.array(*(F.when(missing, F.lit(code)) for code, missing in checks)), lambda x: x.isNotNull())
    return pages.select(key, F.explode(codes).alias("code"))


def html_found_tags(html: Column) -> Column:
    return F.filter(F.array(*(F.when(_tag(html, t), F.lit(t)) for t in STRUCTURE)), lambda x: x.isNotNull())


def shown_attributes(elements: DataFrame) -> DataFrame:
    """doc, ordinal, tag, name, value: the attributes of parsed elements (read_elements) that a reader sees, unless they are empty or blank."""
    rows = elements.select("doc", "ordinal", "tag", F.explode("attrs").alias("name", "value"))
    return rows.where(F.col("name").isin(*L.SHOWN_ATTRIBUTES) & F.col("value").rlike(r"\S"))


def html_findings_of_elements(pages: DataFrame, elements: DataFrame, key: str = "doc") -> DataFrame:
    """key, code by the parsed elements (read_elements): the exact form of html_findings for main pages. A page that
    can't be parsed has the one finding PARSE_ERROR."""
    tag, attrs = F.col("tag"), F.col("attrs")
    value = lambda name: F.coalesce(attrs[name], F.lit(""))
    flags = {f"MISSING_{t.upper()}": tag == t for t in ("header", "nav", "footer")}
    flags["MISSING_META_CHARSET"] = (tag == "meta") & F.map_contains_key(attrs, "charset")
    flags |= {f"MISSING_META_{m.upper()}": (tag == "meta") & (value("name") == m) for m in META}
    # the first html element counts
    root = elements.where(tag == "html").groupBy(key).agg(F.min_by("attrs", "ordinal").alias("root"))
    seen = elements.groupBy(key).agg(F.bool_or(tag == UNPARSED).alias("unparsed"), *(F.bool_or(flag).alias(code) for code, flag in flags.items()))
    rows = pages.select(key).join(seen, key, "left").join(root, key, "left")
    missing = [F.when(~F.coalesce(F.col(code), F.lit(False)), F.lit(code)) for code in flags]
    missing += [
        F.when(F.col("root").isNotNull() & (F.coalesce(F.col("root")[a], F.lit("")) == ""), F.lit(f"MISSING_{a.upper()}_ATTRIBUTE")) for a in ("lang", "dir")
    ]
    found = F.when(F.col("unparsed"), F.array(F.lit("PARSE_ERROR"))).otherwise(F.array_compact(F.array(*missing)))
    return rows.select(key, F.explode(found).alias("code"))


# -- CSS ---------------------------------------------------------------------


def css_rules(declarations: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds code (or null) and fixed (array of struct(prop, value)) to declarations."""
    return first_fit(declarations, rules)


def css_findings(declarations: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    return css_rules(declarations, rules).where("code is not null").select(F.col("path").alias("doc"), "ordinal", "code")


def css_edits(declarations: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """path, start, end, replacement of every declaration that a rule changes; !important stays."""
    ruled = css_rules(declarations, rules).where("fixed is not null")
    mark = F.when(F.col("important"), F.lit(" !important")).otherwise("")
    glue = F.concat(F.lit(";"), F.when(F.col("indent") == "", " ").otherwise(F.col("indent")))
    text = F.array_join(F.transform("fixed", lambda d: F.concat(d["prop"], F.lit(": "), d["value"], mark)), "\u0001")
    return ruled.select("path", "start", "end", F.replace(text, F.lit("\u0001"), glue).alias("replacement"))


# -- JSX ---------------------------------------------------------------------

JSX_PROPERTIES = "doc string, ordinal int, kind string, prop string, value string, style boolean, tags array<string>"


def is_style(own: jsx.Literal) -> bool:
    return own.in_style or any(p.key in L.JSX_STYLE_SIBLINGS for p in own.properties)


def all_elements(roots: list) -> Iterator[jsx.Element]:
    """Every element, parents first, those in expressions and attributes too."""
    for node in roots:
        if isinstance(node, jsx.Element):
            yield node
            inner = [a.value for a in node.attributes if isinstance(a.value, jsx.Expr)] + node.children
            yield from all_elements([x for n in inner for x in (n.elements if isinstance(n, jsx.Expr) else [n])])


def read_properties(files: DataFrame) -> DataFrame:
    """doc, ordinal, kind, prop, value, style of the properties of object literals (kind property), and one row with the tags
    of a file (kind file), or without them if it can't be read (kind unreadable)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in few(frames):
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    source = jsx.Source((content or "").replace("\r\n", "\n"))
                except (SyntaxError, RecursionError):
                    rows.append((path, 0, "unreadable", None, None, None, []))
                    continue
                found = [(p.key, p.value, style) for own in source.objects for style in [is_style(own)] for p in own.properties]
                rows += [(path, k, "property", *p, []) for k, p in enumerate(found)]
                rows.append((path, len(found), "file", None, None, None, sorted({e.name.lower() for e in all_elements(source.roots) if e.name})))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in JSX_PROPERTIES.split(", ")])

    return files.select("path", "content").mapInPandas(scan, JSX_PROPERTIES)


def scan_components(files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """doc, ordinal, code, args of every finding by object literals, and one row with tags (null code) a file.
    A file that can't be read has the one finding PARSE_ERROR."""
    codes = F.when(F.col("kind") == "property", all_fits(rules)).when(F.col("kind") == "unreadable", F.array(F.lit("PARSE_ERROR"))).otherwise(F.array(F.lit(None).cast("string")))
    found = read_properties(files).select("doc", "ordinal", F.explode(codes).alias("code"), "prop", "tags")
    args = F.when(F.col("code") == "AVOID_PHYSICAL_PROP", F.array("prop")).otherwise(F.array().cast("array<string>"))
    return found.select("doc", "ordinal", "code", args.alias("args"), "tags")


CLASS_VALUES = "doc string, ordinal int, value string, start int, end int, pattern string, dynamic boolean, safe_to_mirror boolean"


def safe_to_mirror(node: jsx.Element) -> bool:
    """A drawing that holds drawings only."""
    if node.name not in L.GRAPHIC_TAGS:
        return False
    for child in node.children:
        if isinstance(child, jsx.Expr) or isinstance(child, jsx.Text) and child.value.strip():
            return False
        if isinstance(child, jsx.Element) and not safe_to_mirror(child):
            return False
    return True


def _class_parts(value: jsx.Expr, text: str) -> Iterator[tuple[str, int, int, str]]:
    """(text, start, end, pattern) of the static parts of a class expression."""
    import re

    source, at = value.source, value.at
    if re.fullmatch(r"""(["'])(?:(?!\1).)*\1""", source):
        yield source[1:-1], at + 1, at + len(source) - 1, "string"
    elif source.startswith("`") and source.endswith("`"):
        place = 1
        for part in re.split(r"(\$\{(?:[^{}]|\{[^{}]*\})*\})", source[1:-1]):
            if part and not part.startswith("${"):
                yield part, at + place, at + place + len(part), "template"
            place += len(part)
    elif m := re.fullmatch(r"""[^?"'`]+\?\s*(?P<a>(["'])(?:(?!\2).)*\2)\s*:\s*(?P<b>(["'])(?:(?!\4).)*\4)""", source, re.S):
        for name in "ab":
            yield m[name][1:-1], at + m.start(name) + 1, at + m.end(name) - 1, "ternary"
    elif m := re.fullmatch(r"""[^"'`]+(?:&&|\|\|)\s*(?P<a>(["'])(?:(?!\2).)*\2)""", source, re.S):
        yield m["a"][1:-1], at + m.start("a") + 1, at + m.end("a") - 1, "logical"


def read_class_values(files: DataFrame) -> DataFrame:
    """doc, ordinal, value, start, end, pattern: the static parts of class attributes. A joined (+) expression gives one
    row with dynamic and no value."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in few(frames):
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    source = jsx.Source(content or "")
                except (SyntaxError, RecursionError):
                    continue
                found = []
                for node in all_elements(source.roots):
                    for a in node.attributes:
                        if a.name not in ("className", "class") or a.value is None:
                            continue
                        if isinstance(a.value, str):
                            found.append((a.value, a.start + 1, a.end - 1, "attribute", False, safe_to_mirror(node)))
                            continue
                        parts = [(*p, False, safe_to_mirror(node)) for p in _class_parts(a.value, source.text)]
                        if not parts and "+" in a.value.source:
                            parts = [(None, a.start, a.end, "joined", True, False)]
                        found += parts
                rows += [(path, k, *f) for k, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc", "ordinal", "value", "start", "end", "pattern", "dynamic", "safe_to_mirror"])

    return files.select("path", "content").mapInPandas(scan, CLASS_VALUES)


def jsx_findings(files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """doc, code, args: object literals, class attributes, and the structure of an application's root file."""
    scanned = scan_components(files, rules)
    objects = scanned.where("code is not null").select("doc", "code", "args")
    whole = read_class_values(files).where(F.col("pattern").isin("attribute", "string"))
    none = F.array().cast("array<string>")
    classes = whole.select("doc", F.explode(directional_findings(F.col("value"))).alias("code"), none.alias("args"))
    page = F.array_contains("tags", "main") | F.array_contains("tags", "body")
    missing = F.array(*(F.when(~F.array_contains("tags", t), F.lit(f"MISSING_{t.upper()}")) for t in ("header", "footer")))
    roots = scanned.where(F.col("code").isNull() & component_path(F.col("doc")) & page)
    structure = roots.select("doc", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("code"), none.alias("args"))
    return reduce(DataFrame.unionByName, (objects, classes, structure))


def style_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) for physical keys and sides in the object literals of a source."""
    keys, out = dict(L.JSX_KEYS), []
    for own in jsx.Source(text).objects:
        style = is_style(own)
        for p in own.properties:
            if p.key in keys and (p.key in L.JSX_STRICT or style):
                quote = text[p.key_start] if p.quoted else ""
                new = f"{quote}{keys[p.key]}{quote}"
                short = p.value_start == p.key_start  # {left} becomes {insetInlineStart: left}
                out.append((p.key_start, p.key_end, f"{new}: {p.key}" if short else new))
            sides = {"textAlign": ("start", "end"), "text-align": ("start", "end"), "float": ("inline-start", "inline-end")}.get(p.key)
            if sides and p.value in ("left", "right"):
                quote = text[p.value_start]
                end = p.value_start + len(p.value) + 2
                out.append((p.value_start, end, f"{quote}{sides[p.value == 'right']}{quote}"))
    return sorted(set(out))


EDITS = "path string, start int, end int, replacement string"


def read_style_edits(files: DataFrame) -> DataFrame:
    """path, start, end, replacement; files that can't be read have none."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in few(frames):
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, *e) for e in style_edits(content or "")]
                except (SyntaxError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "start", "end", "replacement"])

    return files.select("path", "content").mapInPandas(scan, EDITS)
