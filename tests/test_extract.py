"""Display texts of components, their keys, and the sources written back."""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
import pytest

from babelyard.operators import audit, edits, extract, registry
from babelyard.operators.keys import next_key_map
from babelyard.plans.lifecycle import extract_project
from babelyard.sources import css, jsx, slices
from babelyard.sources.chains import conditional, parameters, read, takes

FILES = "path string, ext string, content string"
#: Fields of a shop's data files that hold display texts.
SHOP = frozenset({"caption", "perks", "motto"})


def units(markup: str, fields: frozenset[str] = SHOP) -> list[tuple[str, str | None]]:
    """(kind, value or reason) of what stands in a component's outermost element."""
    source = f"export function Parcel(props) {{ return <main>{markup}</main>; }}"
    return [(u.kind, u.value or u.reason) for u in extract.Extractor(jsx.Source(source), fields).out.units]


def table(spark, *files: tuple[str, str | None]):
    return spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1], c) for p, c in files], FILES)


def keys(spark, *files: tuple[str, str], key_map=None) -> dict[str, str]:
    rows = extract.with_keys(extract.extract_units(table(spark, *files)), key_map).where("kind = 'string'").collect()
    return {r.key: r.value for r in rows}


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<p>Parcels leave at noon</p>", "Parcels leave at noon"),
        ("<p>\n  Parcels\n\tleave   at noon </p>", "Parcels leave at noon"),
        ("<p>{weight} kilos in {props.box.size}</p>", "{{weight}} kilos in {{size}}"),
        ("<p>Row {rows[0]} of {rows[last]}</p>", "Row {{var0}} of {{last}}"),
        ("<p>Sent by <em>{courier}</em> on <time>{day}</time></p>", "Sent by <em>{{courier}}</em> on <3>{{day}}</3>"),
        ("<p>Track it <a href='/t'>on the <i>live</i> map</a>.</p>", "Track it <1>on the <i>live</i> map</1>."),
        ("<p>Two<br />lines</p>", "Two<br/>lines"),
        ("<p>Signed {/* a note */} for</p>", "Signed for"),
    ],
)
def test_a_run_is_one_text(markup, text):
    assert units(markup) == [("string", text)]


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<p>{grams(weight)} in all</p>", [("skipped", "complex-expression")]),
        ("<p>From {late ? 9 : 8} on</p>", [("skipped", "complex-expression")]),
        ("<p>Costs <b>{sum(a, b)}</b></p>", [("skipped", "uncollectable-element"), ("skipped", "complex-expression")]),
        ("<p><b>{sum(a, b)}</b> in all</p>", [("string", "in all"), ("skipped", "complex-expression")]),
        ("<p>{item.motto} <b>now</b></p>", [("skipped", "data-promoted-variable-with-inline-markup"), ("wrap", "item.motto"), ("string", "now")]),
        ("<p>{weight}</p>", []),
        ("<p> <b>{weight}</b> </p>", []),
        ("<p data-babelyard-ignore>As <b>it</b> is</p>", []),
        ("<p data-turbo-ignore>Still read</p>", [("string", "Still read")]),
    ],
)
def test_runs_that_are_no_text(markup, expected):
    assert units(markup) == expected


def test_every_mix_of_children_has_an_outcome():
    """All rows of three children: a text takes all of them, or the code that can't be read is named."""
    kinds = {"w": "words", "v": "{size}", "e": "<i>{day}</i>", "X": "{f(1)}", "U": "<i>{f(1)}</i>"}
    for mix in map("".join, product(kinds, repeat=3)):
        got = units("<p>" + "".join(kinds[k] for k in mix) + "</p>", frozenset())
        unread = [v for kind, v in got if kind == "skipped"]
        if set(mix) & set("XU"):
            assert "complex-expression" in unread
            assert ("uncollectable-element" in unread) == bool(re.search("[wv][wve]*U", mix.split("X")[0]))
        else:
            assert [kind for kind, _ in got] == (["string"] if re.search("w|v.*e", mix) else [])


def test_shown_attributes():
    markup = '<input placeholder="Parcel number" aria-label="Number" name="Not shown" title=" " />'
    assert units(markup) == [("string", "Parcel number"), ("string", "Number")]


@pytest.mark.parametrize(
    ("markup", "wrapped"),
    [
        ("<p>{item.caption}</p>", ["item.caption"]),
        ("<p>{item?.caption} each</p>", ["item?.caption"]),
        ("<p>{item.caption.replace(cut(1, (2)), [')'])}</p>", ["item.caption"]),
        ("<ul>{item.perks.map((perk, n) => <li key={n}>{perk}</li>)}</ul>", ["perk"]),
        ("<ul>{(item.perks ?? none(1)).filter(fits(box, [3])).map(perk => <li>{perk}</li>)}</ul>", ["perk"]),
        ("<ul>{item.perks.split(',').map(perk => <li>{perk}</li>)}</ul>", ["item.perks"]),
        ("<ul>{item.sizes.map(size => <li>{size}</li>)}</ul>", []),
        ("<ul>{item.perks.map(({ icon }) => <li>{icon}</li>)}</ul>", []),
        ("<ul>{item.perks.map(p => <li>{p}</li>)}{other.sizes.map(s => <li>{s}</li>)}</ul>", ["p"]),
    ],
)
def test_data_is_translated_where_it_stands(markup, wrapped):
    assert [v for kind, v in units(markup) if kind == "wrap"] == wrapped


def test_conditionals():
    assert units("<Tip note={fits(a ? b : c) ? item.caption : 'Too large'} />") == [("wrap", "item.caption"), ("flat", "Too large")]
    assert units("<Tip note={a ? b ? item.caption : d : 'Too large'} />") == [("flat", "Too large")]
    assert units("<Tip note={a ? b : ' '} />") == []


def test_shapes_of_expressions():
    assert conditional(read("a ? b : c ? d : e"))[1][0].text == "c"
    assert conditional(read("x => x ? 1 : 2")) is None and conditional(read("a?.b")) is None
    assert read("f(1]") == [] and read("f((1)") == []
    assert parameters("(a, { b, c }, [d], e = 2, f: number) => 1") == {"a", "f"} and parameters("async x => x") == {"x"} and parameters("function (x) {}") == set()
    assert takes(read("a || (b ? c.perks : d)"), SHOP) and not takes(read("f(c.perks)"), SHOP)


def test_long_files_take_time_in_proportion():
    row = "<ul>{item.perks.map(perk => <li>{perk}</li>)}</ul>"
    assert [v for kind, v in units(row * 300) if kind == "wrap"] == ["perk"] * 300


def test_roles_hints_and_counters(spark):
    body = "<h1>Depot</h1>{/* i18n: closing */}<p>Closed today</p><li>Lamp</li><li>Desk</li><td>Sum of all parcels sent</td>"
    got = keys(spark, ("src/components/Depot.jsx", f"export default function Depot() {{ return <div>{body}</div>; }}"))
    assert got == {"depot.title": "Depot", "depot.closing": "Closed today", "depot.item": "Lamp", "depot.item2": "Desk", "depot.sumOfAllParcels": "Sum of all parcels sent"}


def test_namespaces_are_apart(spark):
    own = "export default function Row() { return <p>Row of a list</p>; }"
    assert set(keys(spark, ("src/lists/Row.jsx", own), ("src/grids/Row.jsx", own), ("src/Depot.jsx", own))) == {"lists_row.row.body", "grids_row.row.body", "depot.row.body"}


def test_known_keys_stay(spark):
    path, page = "src/Depot.jsx", "export default function Depot() {{ return <div>{}</div>; }}"
    first = extract.with_keys(extract.extract_units(table(spark, (path, page.format("<h2>Depot</h2><p>Open</p>")))))
    held = next_key_map(first.where("kind = 'string'"))
    later = keys(spark, (path, page.format("<h2>Depot</h2><p>Open</p><p>Until six</p>")), key_map=held)
    assert later == {"depot.subtitle": "Depot", "depot.body": "Open", "depot.body2": "Until six"}


def test_sources_are_rewritten(spark):
    source = (
        "import { useTranslation } from 'react-i18next';\n"
        "export const Gate = () => {\n  return <p>Gate {n}</p>;\n};\n"
        "export const Yard = () => {\n  return <p>Yard <b>{m}</b></p>;\n};\n"
    )
    done = extract_project(table(spark, ("src/Site.jsx", source)))
    written = done.files.collect()[0].content
    assert {r.key: r.value for r in done.messages.collect()} == {"site.gate.body": "Gate {{n}}", "site.yard.body": "Yard <b>{{m}}</b>"}
    assert '{t("site.gate.body", { n })}' in written
    assert '<Trans i18nKey="site.yard.body">Yard <b>{{ m }}</b></Trans>' in written
    assert written.count("react-i18next") == 1 and "Trans" in written.splitlines()[0]
    assert written.count("const { t } = useTranslation();") == 1
    again = extract_project(table(spark, ("src/Site.jsx", written)))
    assert again.keyed.where("kind = 'string' and tag = 'p' and value like 'Gate%'").count() == 0


def test_data_folders_are_an_error(spark):
    with pytest.raises(Exception, match="Data-promoted keys must never be passed"):
        keys(spark, ("src/config/depot.js", "export default function Depot() { return <p>Open</p>; }"))


def test_unreadable_files(spark):
    rows = extract.extract_units(table(spark, ("src/A.jsx", "export default function A() { return <div>"), ("src/B.jsx", None))).collect()
    assert [(r.path, r.kind, r.reason) for r in rows] == [("src/A.jsx", "skipped", "parse-error")]


def test_edits(spark):
    files = spark.createDataFrame([("a", "0123456789"), ("b", "abc"), ("c", None)], "path string, content string")
    own = spark.createDataFrame([("a", 2, 4, "X"), ("a", 4, 4, "Y"), ("a", 9, 10, ""), ("b", 0, 2, "x"), ("b", 1, 3, "y")], "path string, start int, end int, replacement string")
    got = {r.path: (r.content, r.n_edits) for r in edits.edit_files(files, own).collect()}
    assert got == {"a": ("01XY45678", 3), "b": ("abc", None), "c": (None, 0)}


def test_static_keys(spark):
    source = "const a = t('one'); const b = i18n.t('two'); const c = tt('three'); // t('four')\nexport default function H() { return <p>{t(\"five\")}<Trans i18nKey=\"six\">x</Trans></p>; }"
    df = spark.createDataFrame([("a.jsx", source)], "path string, content string")
    assert sorted(r.key for r in extract.static_keys(df).collect()) == ["five", "one", "six"]
    assert sorted(r.key for r in extract.static_keys(df, components=()).collect()) == ["five", "one"]


def test_few_files_at_a_time():
    """A frame's files are handed on in slices of bounded length, in order and whole; long, empty and null ones too."""
    own = pd.DataFrame({"path": [str(k) for k in range(7)], "content": ["a" * 4, None, "b" * 5, "c" * 30, "", "d" * 9, "e"]})
    got = list(slices.few(iter([own, own.iloc[:0], own.iloc[:1]]), most=10))
    assert [list(g["path"]) for g in got] == [["0", "1", "2"], ["3"], ["4", "5", "6"], ["0"]]


class Frames:
    """Stands for a table of files: what is mapped over it runs here, on one frame."""

    def __init__(self, frame):
        self.frame = frame

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):  # noqa: N802
        return list(run(iter([self.frame])))


READERS = (extract.extract_units, extract.read_import_edits, extract.static_keys, audit.read_properties, audit.read_class_values, audit.read_style_edits, css.read_declarations)


@pytest.mark.parametrize("reader", READERS)
def test_a_worker_holds_the_rows_of_few_files(reader, monkeypatch):
    """However many files a frame has, their rows come in small frames, and all of them come."""
    source = "export default function A() { return <p className='a' style={{marginLeft: 4}}>{t('k')} <i>Some words</i></p>; }"
    frame = pd.DataFrame({"path": [f"src/a{k}.jsx" for k in range(400)], "content": [source] * 400})
    monkeypatch.setattr(slices, "MOST", 1 << 40)
    whole = pd.concat(reader(Frames(frame)))
    monkeypatch.setattr(slices, "MOST", 10 * len(source))
    small = reader(Frames(frame))
    assert len(whole) >= 400 and len(small) == 40
    assert pd.concat(small).astype(str).values.tolist() == whole.astype(str).values.tolist()


def test_a_worker_holds_the_literals_of_few_files(monkeypatch):
    source = "export const items = { title: 'Some words', list: ['one', 'two'] };"
    frame = pd.DataFrame({"path": [f"src/data/a{k}.js" for k in range(400)], "content": [source] * 400})
    monkeypatch.setattr(slices, "MOST", 10 * len(source))
    small = registry.read_script_leaves(Frames(frame))
    assert [len(x) for x in small] == [30] * 40
