"""Audits, rewrites, classification, sources and project facts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from babelyard.functions import lookups as L
from babelyard.functions import text as T
from babelyard.functions.classes import rewrite_value
from babelyard.operators import audit, edits, registry
from babelyard.plans import facts, queries
from babelyard.plans.lifecycle import audit_project, class_edits, fix_styles
from babelyard.sources import css, files, html, jsontree, trees
from babelyard.sources.html import read_elements

FILES = "path string, ext string, content string"


def one(spark, column, values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column(F.col("v"))).collect()]


CLASSES = {
    "": "skip", "  ﻿": "skip", "12": "skip", "0x10": "skip", "Infinity": "skip", "1e5": "skip", "12d": "identifier", "NaN": "identifier", "true": "skip",
    "https://a.b": "skip", "a@b.co": "skip", "+1 (555) 123-45": "skip", "12-": "identifier", "flex mt-4 p-2": "identifier", "for one user": "translatable",
    "a/b": "skip", "logo.png": "skip", "Hello you": "translatable", "$15": "translatable", "€ 20.5": "translatable", "Free": "translatable", "USD": "identifier",
    "snake_case": "identifier", "camelCase": "identifier",
}


def test_classes(spark):
    assert dict(zip(CLASSES, one(spark, T.classify, CLASSES), strict=True)) == CLASSES
    assert one(spark, T.classify, [None]) == [None]


def test_slugs(spark):
    texts = ["Enter your name", "  The quick, brown fox jumps", "!! Hello World", "", "Ünder x"]
    assert one(spark, T.slug, texts) == ["enterYourName", "theQuickBrownFox", "HelloWorld", "", "nderX"]


def test_small_functions(spark):
    assert one(spark, T.unescape_html, ["a &amp;lt; &quot;b&quot; &#39;"]) == ["a < \"b\" '"]
    assert one(spark, T.major_version, ["^15.1.0", ">=4", "latest", None]) == [15, 4, None, None]
    df = spark.createDataFrame([("src/a/b/C.jsx", "src/lib/i18n.ts"), ("src/C.jsx", "src/i18n.js"), ("C.jsx", "src/x.ts")], "a string, b string")
    assert [r[0] for r in df.select(T.relative_import(F.col("a"), F.col("b"))).collect()] == ["../../lib/i18n", "./i18n", "./src/x"]


VALUES = {
    "ml-2 text-left": ("ms-2 text-start", 2, False), "md:hover:pl-4  flex": ("md:hover:ps-4  flex", 1, False), "rtl:ml-2": ("rtl:ml-2", 0, False),
    "absolute p-1": ("absolute p-1 start-0 top-0", 2, False), "absolute left-0": ("absolute start-0", 1, False), "right-0 translate-x-2": ("end-0 translate-x-2 rtl-mirror", 1, True),
    "-left-4": ("-start-4", 1, False), "": ("", 0, False),
}


def test_class_values(spark):
    got = one(spark, rewrite_value, VALUES)
    assert {k: tuple(r) for k, r in zip(VALUES, got, strict=True)} == VALUES
    assert one(spark, lambda c: rewrite_value(c, True), ["ml-2 left-1 rounded-tl-2"])[0].value == "mis-2 inline-start-1 rounded-ss-2"


def test_style_sheets_have_no_finding_after_the_fix(spark):
    sheet = "@media x { .a { margin-left: 1px; text-align:left } }\n/* left: 1 */ .b { float: right; padding: 1px calc(1px + 2px) 3px 4px !important;\n  border-radius: 1px 2px 3px / 4px; left: 0 }\n.c { margin: 1px 2px; color: red; background: url(a;b) }"
    df = spark.createDataFrame([("a.css", ".css", sheet), ("b.css", ".css", None), ("c.css", ".css", "}{;:")], FILES)
    found = audit.css_findings(css.read_declarations(df))
    assert sorted(r.code for r in found.collect()) == ["FIX_FLOAT", "FIX_LEFT_POSITION", "FIX_MARGIN_LEFT", "FIX_PADDING_SHORTHAND", "FIX_TEXT_ALIGN"]
    fixed = fix_styles(df)
    text = {r.path: r.content for r in fixed.collect()}["a.css"]
    assert "padding-inline-end: calc(1px + 2px) !important" in text and "border-radius: 1px 2px 3px / 4px" in text and "/* left: 1 */" in text
    again = audit.css_findings(css.read_declarations(fixed.select("path", "content")))
    assert again.count() == 0
    assert {r.doc: r.score for r in audit_project(df).collect()} == {"a.css": 75, "b.css": 100, "c.css": 100}


def test_value_parts():
    assert css.space_parts('1px calc(1px + 2px) "a b" x') == ["1px", "calc(1px + 2px)", '"a b"', "x"]


COMPONENT = """
const buttonStyle = { marginLeft: 4, left: 1, textAlign: 'left' as const };
const map = { marginLeft: 'marginInlineStart' };
const plain = { left: 1, float: 'right', borderRadius: '1px 2px 3px 4px' };
const left = 2;
export default function App() {
    return <main style={{left}} className="text-left ml-2 float-right"><svg class="right-0 translate-x-1"><path/></svg><p className={`a ${x} pl-2`}/>
        <i className={on ? "ml-1" : 'mr-1'} /><b className={on && "pr-1"} /><u className={"a" + b} /></main>;
}
"""


def test_components(spark):
    df = spark.createDataFrame([("src/App.jsx", ".jsx", COMPONENT), ("src/bad.jsx", ".jsx", "<div>")], FILES)
    codes = sorted((r.code, ",".join(r.args)) for r in audit.jsx_findings(df).where("doc = 'src/App.jsx'").collect())
    assert codes == sorted([
        ("AVOID_PHYSICAL_PROP", "marginLeft"), ("AVOID_PHYSICAL_PROP", "left"), ("AVOID_TEXT_ALIGN", ""), ("AVOID_FLOAT", ""), ("AVOID_BORDER_RADIUS_SHORTHAND", ""),
        ("AVOID_PHYSICAL_PROP", "left"), ("DETECTED_DIRECTIONAL_CLASS_NAME", ""), ("DETECTED_DIRECTIONAL_CLASS_NAME", ""), ("AVOID_PHYSICAL_MARGIN_PADDING_CLASS", ""),
        ("MISSING_HEADER", ""), ("MISSING_FOOTER", ""),
    ])
    assert {r.doc: r.score for r in audit_project(df).collect()} == {"src/App.jsx": 55, "src/bad.jsx": 0}
    text = {r.path: r.content for r in fix_styles(df).collect()}["src/App.jsx"]
    assert "marginInlineStart: 4, insetInlineStart: 1, textAlign: 'start' as const" in text and "{{insetInlineStart: left}}" in text and "plain = { left: 1, float: 'inline-end'" in text
    found = {r.replacement for r in class_edits(df).collect()}
    assert found == {"text-start ms-2 float-right", "end-0 translate-x-1 rtl-mirror", " ps-2", "ms-1", "me-1", "pe-1"}


def test_pages(spark):
    full = '<!doctype html><html lang="en" dir="ltr"><head><meta charset="u"><meta name="viewport"><meta name="description"><meta name="keywords"><meta name="author"></head><body><header></header><nav></nav><footer></footer></body></html>'
    rows = [(1, full), (2, '<html lang=""><!-- <nav> --><body><br></body></html>'), (3, None), (4, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    scored = {r.page_id: r.score for r in audit.scores(pages, audit.html_findings(pages), "html", "page_id").collect()}
    parsed = audit.html_findings_of_elements(pages.select(F.col("page_id").alias("doc")), html.read_elements(pages))
    exact = {r.doc: r.score for r in audit.scores(pages.select(F.col("page_id").alias("doc")), parsed, "html").collect()}
    assert exact == {1: 100, 2: 5, 3: 15, 4: 15}
    assert scored == {1: 100, 2: 25, 3: 15, 4: 15}  # the pattern form sees the tag in the comment
    assert audit.html_findings(pages, is_react=True).where("page_id = 4 and code = 'MISSING_NAV'").count() == 0


def test_data_files(spark):
    rows = [
        ("src/data/a.json", ".json", '{"title": "Hello you", "list": ["Free", {"id": "x-1"}], "n": 5, "title2": "12"}'), ("src/data/b.json", ".json", "{"),
        ("src/lib/c.js", ".js", "export const items = [{ name: 'Basic', icon: \"flex p-1\", note: `A b` }];\nconst hidden = { name: 'Not this' };"), ("src/x/d.js", ".js", ""),
    ]
    found = files.data_files(spark.createDataFrame(rows, FILES))
    assert sorted(r.path for r in found.collect()) == ["src/data/a.json", "src/data/b.json", "src/lib/c.js"]
    leaves = registry.data_leaves(found)
    own = {(r.path, r.field, r["class"]) for r in registry.registry(leaves).collect()}
    assert own == {
        ("src/data/a.json", "title", "translatable"), ("src/data/a.json", "list", "translatable"), ("src/data/a.json", "id", "identifier"), ("src/data/a.json", "title2", "skip"),
        ("src/lib/c.js", "name", "translatable"), ("src/lib/c.js", "icon", "identifier"), ("src/lib/c.js", "note", "translatable"),
    }
    assert {r.value for r in registry.data_keys(leaves).collect()} == {"Hello you", "Free", "Basic", "A b"}
    assert {r.dot_path for r in registry.data_paths(leaves).where("path like '%a.json'").collect()} == {"title"}


def test_deep_trees():
    node = "x"
    for _ in range(5000):
        node = {"a": node}
    assert [x[1:] for x in jsontree.leaves(node)] == [("a", "a", "x")]


def test_walks(spark, tmp_path):
    for name in ("src/App.jsx", "src/a.css", "src/node_modules/x.js", "src/.git/y.js", "lib/z.ts", "src/_app.jsx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\ny")
    own = files.read_tree(spark, [f"{tmp_path}/src", f"{tmp_path}/lib", f"{tmp_path}/none"], str(tmp_path))
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(files.discover_sources(own)) == ["src/App.jsx", "src/_app.jsx", "src/a.css"]
    assert paths(files.walk(own, "sync")) == ["lib/z.ts", "src/App.jsx", "src/_app.jsx"]
    assert len(paths(files.walk(own, "doctor"))) == 4
    assert files.first_existing(own, ["src/none.js", "lib/z.ts", "src/App.jsx"]).collect()[0].path == "lib/z.ts"
    assert {r.content for r in own.collect()} == {"x\ny"}


def test_locale_modules(spark):
    text = "export const locales = [\n { code: 'en', label: 'English', dir: 'ltr' },\n { code: \"ar\" },\n];\nexport const defaultLocale = 'en';"
    got = files.read_locales(spark.createDataFrame([("src/i18n/locales.ts", ".ts", text)], FILES))
    assert {(r.code, r.is_default) for r in got.collect()} == {("en", True), ("ar", False)}
    table = {r.code: (r.label, r.dir) for r in facts.locale_table(got).collect()}
    assert table == {"en": ("English", "ltr"), "ar": ("Arabic", "rtl")}


def test_language_arrays(spark):
    rows = [("src/a.js", ".js", "x = ['en', \"ar\"]; y = ['ar', 'en']"), ("src/i18n/locales.ts", ".ts", "['en','ar']")]
    df = spark.createDataFrame(rows, FILES)
    assert [(r.path, r.found) for r in facts.language_arrays(df, ["en", "ar"]).collect()] == [("src/a.js", "['en', \"ar\"]")]
    assert facts.language_arrays(df, ["en"]).count() == 0


PROJECTS = [
    ("react only", '{"dependencies":{"react":"18"}}', None, None, False, False, None, "Detection failed"),
    ("pages", "{}", None, None, False, True, "next-i18next", None),
    ("app", "{}", None, None, True, False, "next-intl", None),
    ("both", "{}", None, None, True, True, None, "Ambiguous project"),
    ("flag", "{}", None, "pages-router", True, True, "next-i18next", None),
    ("flag app", "{}", None, "app-router", False, True, "next-intl", None),
    ("dependency", '{"devDependencies":{"next-i18next":"1"}}', None, None, True, True, "next-i18next", None),
    ("two", '{"dependencies":{"next-i18next":"1","next-intl":"1"}}', None, None, True, False, None, "Ambiguous project"),
    ("setting", "not json", "appDir : true", None, False, False, "next-intl", None),
]


@pytest.fixture
def projects(spark):
    rows = [(n, p, c, f, a, g, False, False, ["tailwind.config.js"]) for n, p, c, f, a, g, _, _ in PROJECTS]
    return spark.createDataFrame(rows, facts.FACTS)


def test_adapters(projects):
    got = {r.project: (r.name, r.error) for r in facts.adapter(projects).collect()}
    for name, *_, adapter, error in PROJECTS:
        assert got[name][0] == adapter and (got[name][1] or "").startswith(error or "")


def test_environments(spark):
    rows = [(n, p, None, None, False, False, False, False, f) for n, p, f in [
        ("old", '{"dependencies":{"react":"^15.0"}}', []), ("legacy", '{"devDependencies":{"typescript":"~4.9","next":"12.0","tailwindcss":"^3.1"}}', ["tailwind.config.ts"]),
        ("new", '{"dependencies":{"react":"19","tailwindcss":"latest"}}', []), ("none", None, []),
    ]]
    df = spark.createDataFrame(rows, facts.FACTS)
    assert {r.project: (r.status, r.i18next) for r in facts.environment(df).collect()} == {"old": ("unsupported", None), "legacy": ("legacy", "^22.5.1"), "new": ("supported", "latest"), "none": ("supported", "latest")}
    assert {r.project: (r.version, r.config_path) for r in facts.tailwind(df).collect()} == {"old": (None, None), "legacy": (3, "tailwind.config.ts"), "new": (None, None), "none": (None, None)}


def test_documents_and_linters(spark):
    df = spark.createDataFrame([("a", "pages", True, ["pages/_document.jsx"]), ("b", "pages", True, []), ("c", None, True, []), ("d", "pages", False, [])], "project string, pages_dir string, has_pages_app boolean, files array<string>")
    assert {r.project: (r.doc_path, r.fallback_dest) for r in facts.document_fallback(df).collect()} == {"a": ("pages/_document.jsx", None), "b": (None, "pages/_document.tsx"), "c": (None, None), "d": (None, None)}
    lint = spark.createDataFrame([("a", ".eslintrc", "'project'"), ("b", ".eslintrc.json", '"project" tsconfigRootDir'), ("b", "x.js", "'project'")], "project string, path string, content string")
    assert {r.project: r.warn for r in facts.lint_warning(lint).collect()} == {"a": True, "b": False}


def test_penalties_cover_all_codes():
    assert len({(a, c) for a, c, _, _ in L.PENALTIES}) == len(L.PENALTIES)
    assert {c for _, _, c in L.CSS_PROPS} <= {c for a, c, _, _ in L.PENALTIES if a == "css"}


def test_pages_that_cannot_be_parsed(spark):
    pages = spark.createDataFrame([(1, "<html lang='en'><![foo[x]]></html>"), (2, "<p>a</p>"), (3, None)], "page_id long, html string")
    docs = pages.select(F.col("page_id").alias("doc"))
    found = audit.html_findings_of_elements(docs, read_elements(pages))
    assert [r.code for r in found.where("doc = 1").collect()] == ["PARSE_ERROR"]
    assert {r.doc: r.score for r in audit.scores(docs, found, "html").collect()}[1] == 0
    assert found.where("doc = 2").count() == found.where("doc = 3").count() > 1


def test_trees(spark, tmp_path):
    tree = ("src/a b/é%20.jsx", "src/deep/er/node_modules/x.js", "src/dist/y.js", "src/.hidden.ts", "src/notes.txt", "src/empty.js")
    for name in tree:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"a\xff")
    (tmp_path / "src/again").symlink_to(tmp_path / "src")
    listed = trees.list_tree(spark, [f"file://{tmp_path}/src", f"file://{tmp_path}/src/deep", f"{tmp_path}/none"], ["node_modules", "dist"], [".js", ".jsx", ".ts"])
    assert sorted(r.path.split("/src/")[1] for r in listed.collect()) == [".hidden.ts", "a b/é%20.jsx", "empty.js"]
    held = files.read_tree(spark, [f"{tmp_path}/src"], str(tmp_path), kind="sync")
    assert {r.path: (r.ext, r.content) for r in held.collect()} == {"src/a b/é%20.jsx": (".jsx", "a�"), "src/.hidden.ts": (".ts", "a�"), "src/empty.js": (".js", "")}
    assert {r.path for r in files.read_tree(spark, [str(tmp_path)], str(tmp_path)).collect()} == set(tree)
    assert files.read_tree(spark, []).count() == 0


def test_entries_of_a_folder(tmp_path):
    (tmp_path / "keep/build").mkdir(parents=True)
    (tmp_path / "keep/build/x.js").write_text("x")
    assert [e[0] for e in trees._entries(f"{tmp_path}/keep", frozenset(["build"]), ())] == []
    assert [e[1] for e in trees._entries(f"{tmp_path}/keep", frozenset(), ())] == [True]
    assert list(trees._entries(f"{tmp_path}/none", frozenset(), ())) == []


def test_shown_attributes(spark):
    pages = spark.createDataFrame([(1, "<img alt='a &amp; b' title=' ' src=x><input PLACEHOLDER=now alt>"), (2, None), (3, "<![unknown[")], "page_id long, html string")
    found = audit.shown_attributes(html.read_elements(pages)).select("doc", "name", "value").collect()
    assert sorted(map(tuple, found)) == [(1, "alt", "a & b"), (1, "placeholder", "now")]


def test_odd_sheets():
    """Signs in comments, strings and brackets end nothing."""
    sheet = "a{color:red/*;}*/;b: url(x;y) ' ; ' !IMPORTANT} @media (x){ p { q : \"a\\\";b\" ;; r:1 } } s: 'open\n;t:/ 2"
    found = [(d.prop, d.value, d.important, sheet[d.start : d.end]) for d in css.declarations(sheet)]
    assert [f[:3] for f in found] == [("color", "red", False), ("b", "url(x;y) ' ; '", True), ("q", '"a\\";b"', False), ("r", "1", False), ("s", "'open", False), ("t", "/ 2", False)]
    assert all(text.startswith(prop) for prop, _, _, text in found)
    assert css.declarations("") == css.declarations("}{;:/*") == []
    assert css.space_parts("") == css.space_parts(" \n") == []
    assert css.space_parts(" a) 'b c\" d' (e\tf ( g)) \u00a0h\n") == ["a)", "'b c\" d'", "(e\tf ( g))", "\u00a0h"]


def test_sheets_are_dealt_and_read_once(spark, sf):
    """A table in one split is parsed by many tasks, and edits of a file are made once."""
    sheets = queries._sheets(spark, sf)
    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() == 1 < sheets.rdd.getNumPartitions()
    fixed = edits.edit_files(sheets, audit.css_edits(css.read_declarations(sheets)))
    assert fixed._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
