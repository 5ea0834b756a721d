"""Catalogues: comparison, migration, incremental state, translation."""

from __future__ import annotations

from babelyard.functions.tokens import detokenize, tokenize, variables
from babelyard.operators import sync, translate
from babelyard.plans.lifecycle import Config, sync_project
from babelyard.streaming.incremental import FileState, incremental_run, stream_files
from pyspark.sql import functions as F

FILES = "path string, ext string, content string"


def project(spark, data, en, ar):
    rows = [
        ("src/data/pricing.json", ".json", data), ("src/App.jsx", ".jsx", "const App = () => { return <p>{t('Some static key')}</p>; };"),
        ("src/i18n/messages/en.json", ".json", en), ("src/i18n/messages/ar.json", ".json", ar),
    ]
    return spark.createDataFrame(rows, FILES)


PRICING = '{"pricing": {"items": [{"name": "Free", "priceDetails": "for one user"}]}}'


def test_report(spark):
    files = project(spark, PRICING, '{"Free": "Free", "for one user": "for one user", "Some static key": "Some static key"}', '{"Free": "x", "for one user": "y"}')
    for _ in range(2):
        got = sync_project(files, Config(languages=["en", "ar"]))
        r = got.report.collect()[0]
        assert (r.n_new, r.n_orphans, r.n_missing, r.percent, r.ok) == (0, 0, 1, 66.67, False)
    assert {(x.path, x.dot_path, x.value) for x in got.snapshot.collect()} == {("src/data/pricing.json", "pricing.items.0.name", "Free"), ("src/data/pricing.json", "pricing.items.0.priceDetails", "for one user")}


def test_migration(spark):
    old = project(spark, '{"title": "Hello", "description": "World"}', '{"Hello": "Hello", "World": "World", "Some static key": "s"}', '{"Hello": "A", "World": "B"}')
    before = sync_project(old, Config()).snapshot
    new = project(spark, '{"title": "Hello Everyone", "description": "World"}', '{"Hello": "Hello", "World": "World", "Some static key": "s"}', '{"Hello": "A", "World": "B"}')
    got = sync_project(new, Config(), before, migrate=True)
    assert [(r.old_key, r.new_key) for r in got.value_edits.collect()] == [("Hello", "Hello Everyone")]
    rows = {(r.locale, r.key): r.value for r in got.messages.collect()}
    assert rows["ar", "Hello Everyone"] == "A" and rows["en", "Hello Everyone"] == "Hello Everyone"
    assert ("en", "Hello") not in rows and ("ar", "Hello") not in rows
    assert sync_project(new, Config(), got.snapshot).value_edits.count() == 0


def test_thresholds_and_empty_catalogues(spark):
    none = spark.createDataFrame([], "locale string, key string, value string")
    valid = spark.createDataFrame([("a",)], "key string")
    r = sync.reconcile(valid, none, ["en", "de"], "en").collect()[0]
    assert (r.n_new, r.total, r.percent, r.ok) == (1, 0, 100.0, True)
    m = spark.createDataFrame([("en", "a", "A"), ("en", "b", "B"), ("de", "a", ""), ("en", "_deprecated", "x")], none.schema)
    r = sync.reconcile(valid, m, ["en", "de"], "en", threshold=0).collect()[0]
    assert (r.n_orphans, r.percent, r.ok) == (1, 100.0, False)
    assert sync.reconcile(valid, m, ["en", "de"], "en", prune=True).collect()[0].ok
    assert {(r.present, r.filled) for r in sync.coverage_cells(valid, m, ["en", "de"], "en").collect()} == {(True, False)}
    left = sync.write_back(m, valid, "en", prune=True)
    assert {(r.locale, r.key) for r in left.collect()} == {("en", "a"), ("de", "a"), ("en", "_deprecated")}


def test_seeding_is_insert_only(spark):
    m = spark.createDataFrame([("en", "k", "old")], "locale string, key string, value string")
    out = sync.seed_locales(m, spark.createDataFrame([("k", "new"), ("n", "text")], "key string, value string"), ["en", "ar"], "en")
    assert {(r.locale, r.key, r.value) for r in out.collect()} == {("en", "k", "old"), ("en", "n", "text"), ("ar", "k", ""), ("ar", "n", "")}


def test_incremental_state(spark, tmp_path):
    state = FileState(spark, f"file://{tmp_path}/state")
    files = spark.createDataFrame([("a.jsx", ".jsx", "one"), ("b.jsx", ".jsx", "two")], FILES)
    seen = []

    def work(changed):
        seen.append(sorted(r.path for r in changed.collect()))

    assert incremental_run(files, state, work)
    assert not incremental_run(files, state, work)
    edited = spark.createDataFrame([("a.jsx", ".jsx", "one"), ("b.jsx", ".jsx", "three")], FILES)
    assert incremental_run(edited, state, work)
    (tmp_path / "state" / "mtime-9").mkdir()
    assert not incremental_run(edited, state, work)
    assert seen == [["a.jsx", "b.jsx"], ["b.jsx"]]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsx").write_text("one")
    seen = []
    for name in ("b.jsx", "c.jsx"):
        stream_files(spark, f"file://{tmp_path}/in", lambda df, _: seen.extend(sorted(r.ext + r.content for r in df.collect())), f"file://{tmp_path}/check").awaitTermination()
        (tmp_path / "in" / name).write_text(name)
    assert seen == [".jsxone", ".jsxb.jsx"]


TOKENS = [
    ("Hello {{name}}!", 'Hello <v id="0" />!', ["name"]),
    ("Hi {{ name }}", 'Hi <v id="0" />', ["name"]),
    ("Raw {{{value}}} output", 'Raw <v id="0" /> output', ["value"]),
    ("{{a}}{{b}}{{a}}", '<v id="0" /><v id="1" /><v id="2" />', ["a", "b", "a"]),
    ("plain text", "plain text", []),
    ("oops {{name", "oops {{name", []),
    ("Hello <strong>{{name}}</strong>", 'Hello <strong><v id="0" /></strong>', ["name"]),
]


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in TOKENS], "t string").select("t", tokenize(F.col("t")).alias("x"), variables(F.col("t")).alias("v"))
    rows = {r.t: r for r in df.withColumn("back", detokenize(F.col("x"), F.col("v"))).collect()}
    for text, tokenized, names in TOKENS:
        assert (rows[text].x, [v.inner for v in rows[text].v], rows[text].back) == (tokenized, names, text)
    held = F.array(*(F.struct(F.lit(f).alias("full"), F.lit(f).alias("inner")) for f in ("{{first}}", "{{second}}")))
    odd = ['Luego <v id="1" /> y <v id="0" />', 'Hola <v id="0"></v>', "x <v id='1' />", 'no <v id="7" />', 'open <v id="0"']
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(detokenize(F.col("t"), held)).collect()
    assert [r[0] for r in got] == ["Luego {{second}} y {{first}}", "Hola {{first}}", "x {{second}}", 'no <v id="7" />', 'open <v id="0"']


def test_provider_failures(spark):
    class Broken:
        def translate_batch(self, texts, target, source):
            if target == "de":
                raise RuntimeError("no service")
            return [None if t.startswith("skip") else t.upper().replace("V ID", "v id") for t in texts]

    m = spark.createDataFrame([("en", f"k{i}", ("skip " if i % 10 == 0 else "text ") + f"{i} {{{{x}}}}") for i in range(250)], "locale string, key string, value string")
    held = spark.createDataFrame([("de", "k5", "alt"), ("fr", "k5", "vieux")], m.schema)
    rows = translate.run_translations(m.unionByName(held), ["de", "fr", "en"], "en", Broken()).collect()
    got = {(r.locale, r.key): r.value for r in rows}
    assert len(rows) == len(got) == 501 and got["de", "k5"] == "alt" and got["fr", "k5"] == "TEXT 5 {{x}}" and got["fr", "k10"] == "skip 10 {{x}}"
    delta = translate.run_translations(m.unionByName(held), ["de", "fr"], "en", Broken(), spark.createDataFrame([("k5",), ("k6",)], "key string")).collect()
    assert {(r.locale, r.key): r.value for r in delta if r.locale != "en"} == {("de", "k5"): "alt", ("fr", "k5"): "TEXT 5 {{x}}", ("fr", "k6"): "TEXT 6 {{x}}"}
    failed = translate.failed_languages(translate.translate_messages(m, ["de", "fr"], "en", Broken())).collect()
    assert [tuple(r) for r in failed] == [("de", 250, "RuntimeError: no service")]


def test_payload_walks_paths(spark):
    m = spark.createDataFrame([("en", "a", '{"b": {"c": "deep", "d": 1}}'), ("en", "a.b", "flat"), ("en", "x", "plain"), ("de", "y", "{}")], "locale string, key string, value string")
    asked = spark.createDataFrame([(k,) for k in ("a.b.c", "a.b", "x", "x.y", "a.z", "y.z", "a'.b", "a.b'c", "New text. Here")], "key string")
    got = {r.key: r.value for r in translate.payload(m, "en", asked).collect()}
    assert got == {"a.b.c": "deep", "a.b": "flat", "x": "plain", **{k: k for k in ("x.y", "a.z", "y.z", "a'.b", "a.b'c", "New text. Here")}}
