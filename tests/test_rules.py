"""Rules as rows, edits that are verified, answers that are kept, keys that moved more than once."""

from __future__ import annotations

import pytest

from babelyard.operators import audit, edits, sync, translate
from babelyard.operators.rules import CSS_RULES, DEFAULT_RULES, Rule, points
from babelyard.plans.lifecycle import audit_project, fix_styles
from babelyard.sources.css import read_declarations

FILES = "path string, ext string, content string"
SHEET = ".a { margin-left: 2px !important; zoom: 2; float: left }"


def sheets(spark, *texts):
    return spark.createDataFrame([(f"{k}.css", ".css", t) for k, t in enumerate(texts)], FILES)


def test_a_users_rule_finds_counts_and_fixes(spark):
    rules = (*DEFAULT_RULES, Rule("css", "zoom", "try_cast(value as int) > 1", "NO_ZOOM", 30, "critical", "array(struct('scale' as prop, value as value))"))
    files = sheets(spark, SHEET, ".b { zoom: 1 }", ".c { zoom: big }")
    assert [(r.doc, r.score, r.n_findings) for r in audit_project(files, rules).orderBy("doc").collect()] == [("0.css", 60, 3), ("1.css", 100, 0), ("2.css", 100, 0)]
    assert fix_styles(files, rules).orderBy("path").first().content == ".a { margin-inline-start: 2px !important; scale: 2; float: inline-start }"
    assert [(r.doc, r.score) for r in audit_project(files).where("n_findings > 0").collect()] == [("0.css", 90)]


def test_rules_can_be_left_out_and_outranked(spark):
    own = read_declarations(sheets(spark, SHEET))
    only = tuple(r for r in CSS_RULES if r.prop != "float")
    assert [r.code for r in audit.css_findings(own, only).collect()] == ["FIX_MARGIN_LEFT"]
    first = (Rule("css", "margin-left", "important", "NO_MARK"), *CSS_RULES)
    assert sorted(r.code for r in audit.css_findings(own, first).collect()) == ["FIX_FLOAT", "NO_MARK"]
    assert audit.css_edits(own, first).count() == 1  # a rule without a fix leaves its declaration
    assert audit.css_findings(own, ()).count() == 0


def test_points_of_fixed_rules_stay():
    assert ("css", "FIX_FLOAT", 5, "warning") in points(DEFAULT_RULES)
    assert ("css", "FIX_FLOAT", 9, "info") in points((*DEFAULT_RULES, Rule("css", "float", "true", "FIX_FLOAT", 9, "info")))


@pytest.mark.parametrize(
    ("literal", "codes"),
    [
        ("{ marginLeft: 4 }", ["AVOID_PHYSICAL_PROP"]), ("{ marginLeft: 'marginInlineStart' }", []), ("{ left: 1 }", []), ("{ left: 1, color: 'red' }", ["AVOID_PHYSICAL_PROP"]),
        ("{ textAlign: 'left' }", ["AVOID_TEXT_ALIGN"]), ("{ textAlign: 'center' }", []), ("{ float: 'right' }", ["AVOID_FLOAT"]),
        ("{ borderRadius: '1px 2px 3px 4px' }", ["AVOID_BORDER_RADIUS_SHORTHAND"]), ("{ borderRadius: '1px 2px' }", []),
    ],
)
def test_object_literals(spark, literal, codes):
    files = spark.createDataFrame([("a.jsx", ".jsx", f"const x = {literal};")], FILES)
    assert [r.code for r in audit.scan_components(files).where("code is not null").orderBy("ordinal").collect()] == codes


def test_edits_are_rolled_back_file_by_file(spark):
    good, bad = "const A = () => <p>one</p>;", "const B = () => <p>two</p>;"
    files = spark.createDataFrame([("a.jsx", good), ("b.jsx", bad), ("c.jsx", "<p>broken before"), ("d.css", "}"), ("e.jsx", good), ("f.jsx", good)], "path string, content string")
    rows = [("a.jsx", 19, 22, "1"), ("b.jsx", 22, 26, ""), ("c.jsx", 0, 0, " "), ("d.css", 0, 0, "x"), ("f.jsx", 0, 3, "let"), ("f.jsx", 1, 2, "!")]
    done = edits.verify_edits(files, edits.edit_files(files, spark.createDataFrame(rows, "path string, start int, end int, replacement string")))
    got = {r.path: (r.content, r.n_edits, r.failed) for r in done.collect()}
    assert got == {
        "a.jsx": ("const A = () => <p>1</p>;", 1, False), "b.jsx": (bad, 0, True), "c.jsx": (" <p>broken before", 1, False), "d.css": ("x}", 1, False),
        "e.jsx": (good, 0, False), "f.jsx": (good, 0, True),
    }


def counting(path: str, gaps: bool = False):
    """A provider that writes down what it is asked."""

    class Counting:  # of no module, so that tasks get the class itself
        def translate_batch(self, texts, target, source):
            with open(path, "a") as f:
                f.writelines(f"{target}:{t}\n" for t in texts)
            return [None if gaps and t == "b" else f"{target} {t}" for t in texts]

    return Counting()


def test_a_second_run_asks_nothing(spark, tmp_path):
    memory = translate.TranslationMemory(spark, f"file://{tmp_path}/memory")
    messages = spark.createDataFrame([("en", "k1", "a"), ("en", "k2", "b"), ("en", "k3", "a")], "locale string, key string, value string")
    asked = tmp_path / "asked"
    run = lambda m, gaps=False: {(r.locale, r.key): r.value for r in translate.translate_messages(m, ["ar", "es"], "en", counting(str(asked), gaps), memory).collect()}
    first = run(messages, gaps=True)
    assert first["ar", "k1"] == first["ar", "k3"] == "ar a" and first["es", "k2"] == "b"  # without an answer the text stays
    assert sorted(asked.read_text().split()) == ["ar:a", "ar:b", "es:a", "es:b"]
    asked.write_text("")
    assert run(messages)["es", "k2"] == "es b" and sorted(asked.read_text().split()) == ["ar:b", "es:b"]
    asked.write_text("")
    assert run(messages)["es", "k2"] == "es b" and asked.read_text() == ""
    assert {r.target for r in memory.answers("de").collect()} == set()


def test_a_failed_write_of_answers_counts_for_nothing(spark, tmp_path):
    memory = translate.TranslationMemory(spark, f"file://{tmp_path}/memory")
    (tmp_path / "memory" / "run-x").mkdir(parents=True)
    (tmp_path / "memory" / "run-x" / "part-0.parquet").write_bytes(b"half")
    assert memory.answers("en").count() == 0


EDITS = "step long, old_key string, new_key string"


def moved(spark, *rows):
    return {r.old_key: r.new_key for r in sync.moved_keys(spark.createDataFrame(list(rows), EDITS)).collect()}


def test_keys_that_move_again(spark):
    assert moved(spark, (1, "A", "B"), (2, "B", "C"), (5, "C", "D")) == {"A": "D", "B": "D", "C": "D"}
    assert moved(spark, (2, "A", "B"), (1, "B", "C")) == {"A": "B", "B": "C"}  # B moved away before A came
    assert moved(spark, (1, "A", "B"), (2, "B", "A")) == {"B": "A"}
    assert moved(spark, (1, "A", "X"), (1, "B", "X"), (3, "X", "Y"), (4, "A", "Z")) == {"A": "Y", "B": "Y", "X": "Y"}
    assert moved(spark) == {}


def test_a_long_chain(spark):
    chain = [(k, f"k{k}", f"k{k + 1}") for k in range(37)]
    assert moved(spark, *chain) == {f"k{k}": "k37" for k in range(37)}


def test_translations_follow_over_three_snapshots(spark):
    rows = [(0, "p", "v", "A"), (1, "p", "v", "B"), (2, "p", "v", "C"), (0, "p", "w", "S"), (1, "p", "w", "S"), (2, "p", "w", "T"), (2, "q", "v", "S")]
    history = sync.history_edits(spark.createDataFrame(rows, "step long, path string, dot_path string, value string"))
    messages = spark.createDataFrame([("en", "A", "A"), ("ar", "A", "alef"), ("en", "S", "S")], "locale string, key string, value string")
    got = {(r.locale, r.key): r.value for r in sync.migrate(messages, sync.moved_keys(history), "en").collect()}
    assert got == {("en", "C"): "C", ("ar", "C"): "alef", ("en", "S"): "S"}  # S still stands elsewhere
