"""Catalogues as files: layouts by adapter, writes that replace whole files, catalogues of any size."""

from __future__ import annotations

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from babelyard.plans import queries
from babelyard.sources import catalogues, files, scratch

MESSAGES = "project string, locale string, key string, value string, name string, file string, n long, total long"
STORE, COPY = "src/i18n/messages/{}.json", "public/locales/{}/common.json"


@pytest.fixture
def make(spark):
    """Messages with columns whose names the writer uses inside, and projects' adapters."""

    def build(rows, adapters=(("", "next-i18next"),)):
        own = spark.createDataFrame([(*r, "x", "x", 7, 7) for r in rows], MESSAGES)
        return own, spark.createDataFrame(list(adapters), "project string, name string")

    return build


def written(root: Path) -> dict[str, dict]:
    return {str(p.relative_to(root)): json.loads(p.read_text()) for p in root.rglob("*.json")}


def test_layouts_by_adapter(make, tmp_path):
    rows = [("a", "en", "k", "v"), ("b", "en", "k", "v"), ("b", "pt-BR", "k", "w"), ("c", "en", "k", "v"), ("d", "en", "k", "v")]
    own, adapters = make(rows, [("a", "next-intl"), ("b", "next-i18next"), ("c", None), ("other", "next-i18next")])
    done = catalogues.write_catalogues(catalogues.with_paths(own, adapters), str(tmp_path))
    expected = {f"{p}/" + STORE.format("en") for p in "abcd"} | {"b/" + STORE.format("pt-BR"), "b/" + COPY.format("en"), "b/" + COPY.format("pt-BR")}
    assert set(done) == expected == set(written(tmp_path))
    assert written(tmp_path)["b/" + COPY.format("pt-BR")] == {"k": "w"}


def test_odd_values(spark, make, tmp_path):
    """Nulls, quotes, lines, commas, signs beyond ASCII, repeated keys; locales that name no file."""
    texts = {"": "", "a,": None, 'q"\\': 'say "x"\\', "lines": "a\nb\r\n\tc", "comma": "x,", "braces": "{\n}", "اسم": "مرحبا 😀", "long": "x" * 200_000}
    rows = [("", "en", k, v) for k, v in texts.items()] + [("", "en", "twice", "a"), ("", "en", "twice", "b"), ("", "en", "twice", None)]
    lost = [("", None, "k", "v"), ("", "en", None, "v"), ("", "../up", "k", "v"), ("", "", "k", "v")]
    own, adapters = make(rows + lost)
    done = catalogues.write_catalogues(catalogues.with_paths(own, adapters), f"file://{tmp_path}")
    assert done == [COPY.format("en"), STORE.format("en")]
    for name in done:
        assert written(tmp_path)[name] == texts | {"twice": "b"}
        assert list(written(tmp_path)[name]) == sorted(written(tmp_path)[name], key=str.encode)
    back = catalogues.read_catalogues(spark, f"file://{tmp_path}", [*done, "src/i18n/messages/none.json"]).collect()
    assert {(r.file, r.locale, r.key): r.value for r in back} == {(f, "en", k): v for f in done for k, v in (texts | {"twice": "b"}).items()}
    assert catalogues.misplaced(own).count() == len(lost)
    whole = files.read_messages(files.read_tree(spark, [f"{tmp_path}/src"], str(tmp_path)))
    assert {r.key: r.value for r in whole.collect()} == texts | {"twice": "b"}


def test_empty(spark, make, tmp_path):
    own, adapters = make([])
    assert catalogues.write_catalogues(catalogues.with_paths(own, adapters), str(tmp_path)) == []
    assert catalogues.read_catalogues(spark, str(tmp_path), ["src/i18n/messages/en.json"]).count() == 0
    assert list(tmp_path.iterdir()) == []


def test_a_write_replaces_its_files_only(make, tmp_path):
    for rows in ([("", "en", "k", "old"), ("", "de", "k", "alt")], [("", "en", "k", "new")]):
        own, adapters = make(rows, [("", "next-intl")])
        catalogues.write_catalogues(catalogues.with_paths(own, adapters), str(tmp_path))
    assert written(tmp_path) == {STORE.format("en"): {"k": "new"}, STORE.format("de"): {"k": "alt"}}


def test_an_aborted_write_leaves_the_old_files(make, tmp_path):
    own, adapters = make([("", "en", "k", "old")])
    catalogues.write_catalogues(catalogues.with_paths(own, adapters), str(tmp_path))
    before = written(tmp_path)
    new, _ = make([("", "en", f"k{i}", "new") for i in range(100)])
    broken = new.withColumn("value", F.when(F.col("key") == "k77", F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        catalogues.write_catalogues(catalogues.with_paths(broken, adapters), str(tmp_path))
    assert written(tmp_path) == before
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".catalogues")]


def test_large_locale(spark, tmp_path):
    """One locale with nearly all keys: lines of one message each, in order, from many partitions."""
    keys = spark.range(60_000).select(F.lit("en.json").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").cast("string").alias("value"))
    own = keys.unionByName(spark.createDataFrame([("de.json", "k", "v")], keys.columns))
    lines = catalogues.catalogue_lines(own)
    assert lines.agg(F.max(F.length("line"))).first()[0] < 100
    assert [r.n for r in lines.where("file = 'en.json'").select("n").orderBy("n").collect()] == list(range(1, 60_001))
    assert catalogues.write_catalogues(own, str(tmp_path)) == ["de.json", "en.json"]
    held = written(tmp_path)["en.json"]
    assert len(held) == 60_000 and list(held) == sorted(held)


def test_large_file_by_many_tasks(spark, tmp_path, monkeypatch):
    """Tasks write stretches of one file, and none the whole; so does the write that replaces it. Nothing is left beside."""
    seen, join = [], catalogues._join
    monkeypatch.setattr(catalogues, "_join", lambda s, system, joins: (seen.append([(w.getParent().getName(), [n for _, n in p]) for w, p in joins]), join(s, system, joins)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in (3_000, 20_000):
            keys = spark.range(rows).select(F.lit("big/en.json").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("key"), F.concat(F.lit("é\n"), "id").alias("value"))
            own = keys.unionByName(spark.createDataFrame([("de.json", "k", "v")], keys.columns))
            assert catalogues.write_catalogues(own, str(tmp_path)) == ["big/en.json", "de.json"]
            (name, sizes), held = seen[-1][0], written(tmp_path)["big/en.json"]
            assert len(seen[-1]) == 1 and "en.json" in name and len(sizes) > 1
            assert max(sizes) < 0.7 * (tmp_path / "big/en.json").stat().st_size
            assert held == {r.key: r.value for r in keys.collect()} and list(held) == sorted(held)
            back = catalogues.read_catalogues(spark, str(tmp_path), ["big/en.json"]).select("key", "value")
            assert {r.key: r.value for r in back.collect()} == held
            assert sorted(p.name for p in tmp_path.rglob("*") if p.suffix != ".crc") == ["big", "de.json", "en.json"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_disk(spark, tmp_path, monkeypatch):
    """Before files are put together there are no shuffle files and each message is written once; afterwards the parts are gone."""
    join, seen = catalogues._join, {}

    def shuffled():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in held.split() if "/shuffle_" in f}

    def watched(spark, system, joins):
        folder = Path(joins[0][0].toUri().getPath()).parent.parent
        size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
        end = time.time() + 20  # files are deleted in the background
        while shuffled() - files_before and time.time() < end:
            time.sleep(0.2)
        seen["shuffled"], seen["parts"] = shuffled() - files_before, size()
        join(spark, system, joins)
        seen["joined"], seen["files"] = size(), sum(n for _, parts in joins for _, n in parts)

    monkeypatch.setattr(catalogues, "_join", watched)
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4_000, "en").otherwise("de").alias("lang"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 10).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    conf, files_before = {k: spark.conf.get(k, None) for k in (scratch.CLEANUP_CONF, scratch.ADVISORY_CONF)}, shuffled()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert queries.catalogue_files(spark, str(tmp_path)).distinct().count() == 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not seen["shuffled"]
    assert seen["files"] > 2 * 640 * 5_000 and seen["parts"] < 0.6 * seen["files"] and seen["joined"] < 1.1 * seen["files"]
    assert {k: spark.conf.get(k, None) for k in conf} == conf


def test_projects_are_written_as_their_rows_would_be(spark, make, tmp_path, monkeypatch):
    """Adapters named twice, without layout, of projects without messages; the same files, byte by byte, in either way."""
    rows = [(p, loc, f"k{i}", f"{p}{loc}{i}") for p in ("", "a", "b", "c/d", "é %") for loc in ("en", "pt-BR") for i in range(3)] + [("b", "../up", "k", "v")]
    adapters = [("a", "next-intl"), ("b", "next-i18next"), ("b", "next-intl"), ("b", None), ("c/d", "next-i18next"), ("é %", "next-i18next"), ("gone", "next-i18next"), (None, "next-i18next")]
    held = lambda root: {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*.json")}
    own, named = make(rows, adapters)
    done = catalogues.write_projects(own, named, str(tmp_path / "once"))
    assert done == catalogues.write_catalogues(catalogues.with_paths(own, named), str(tmp_path / "rows"))
    assert set(done) == set(held(tmp_path / "once")) and held(tmp_path / "once") == held(tmp_path / "rows") and len(done) == 10 + 6
    assert held(tmp_path / "once")["b/" + COPY.format("en")] == held(tmp_path / "once")["b/" + STORE.format("en")]
    # where stretches can't be put together, one task writes a file
    monkeypatch.setattr(catalogues, "_joins", lambda system, path: False)
    monkeypatch.setattr(catalogues, "_join", lambda spark, system, joins: pytest.fail("a file in parts") if joins else None)
    assert catalogues.write_catalogues(catalogues.with_paths(own, named), str(tmp_path / "whole")) == done
    assert held(tmp_path / "whole") == held(tmp_path / "rows")
    # where tasks can't write to a place in a file, rows are dealt for each file
    monkeypatch.setattr(catalogues, "_write", lambda messages, root, also: (messages.count(), also))
    monkeypatch.setattr(catalogues, "_local", lambda system: False)
    assert catalogues.write_projects(own, named, str(tmp_path / "other")) == (3 * (4 + 2 * 2 + 2 * 2 + 6 + 2), {})


def test_a_key_of_many_rows(spark, tmp_path, monkeypatch):
    """Its greatest value is taken before rows are dealt; nulls, and the ends of a file, among such keys."""
    monkeypatch.setattr(catalogues, "HOT", 10)
    rows = [("f.json", k, None if v is None else f"{v}{i:03}") for k, v, n in (("a", "x", 300), ("b", "y", 2), ("c", None, 300), ("d", "z", 11)) for i in range(n)]
    own = spark.createDataFrame([*rows, ("g.json", "a", "only")], "file string, key string, value string").repartition(3)
    counts = own.groupBy("file", "key").agg(F.count("*").alias("n"))
    assert catalogues._thinned(own, counts).count() == 1 + 2 + 1 + 1 + 1
    assert [r.n for r in catalogues.catalogue_lines(own).where("file = 'f.json'").orderBy("n").collect()] == [1, 2, 3, 4]
    assert catalogues.write_catalogues(own, str(tmp_path)) == ["f.json", "g.json"]
    assert (tmp_path / "f.json").read_text() == '{\n  "a": "x299",\n  "b": "y001",\n  "c": null,\n  "d": "z010"\n}\n'
    assert (tmp_path / "g.json").read_text() == '{\n  "a": "only"\n}\n'


def test_keys_that_change_from_read_to_read(spark, tmp_path):
    """An entry that only the ends know isn't made up."""
    old = spark.createDataFrame([("f.json", "a", "v"), ("f.json", "b", "w")], "file string, key string, value string")
    seen = catalogues.written
    try:
        catalogues.written = lambda df, name: seen(df.unionByName(spark.createDataFrame([("f.json", "c", 1)], df.schema)), name)
        with pytest.raises(Exception, match="read again"):
            catalogues.write_catalogues(old, str(tmp_path))
    finally:
        catalogues.written = seen
    assert list(tmp_path.rglob("*.json")) == []


def test_a_part_is_placed_again(tmp_path):
    """A task that is run again where its part has gone; a part that never was isn't passed over."""
    part, wholes = tmp_path / "part-0", [tmp_path / "a", tmp_path / "b"]
    part.write_text("xyz")
    for w in wholes:
        w.write_text("")
    piece = (str(part), [(str(w), 2 * k) for k, w in enumerate(wholes)])
    for _ in range(2):
        catalogues._place(piece)
        assert [w.read_bytes() for w in wholes] == [b"xyz", b"\0\0xyz"] and not part.exists()
    with pytest.raises(FileNotFoundError):
        catalogues._place((f"{part}1", piece[1]))


def test_a_store_joins_parts(spark, tmp_path):
    """The call for stores that join files themselves, here on the one such system that needs no cluster."""
    jvm, names = spark.sparkContext._jvm, "abc"
    raw = jvm.org.apache.hadoop.fs.RawLocalFileSystem()
    raw.initialize(jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    for n in names:
        (tmp_path / n).write_text(n * 3)
    at = lambda n: jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/{n}")
    catalogues._concat(spark, raw, at("whole"), [at(n) for n in names])
    assert (tmp_path / "whole").read_text() == "aaabbbccc"


def test_locales_without_messages(spark, tmp_path):
    own = spark.createDataFrame([("en", "k", "v")], "locale string, key string, value string")
    locales = spark.createDataFrame([("en",), ("de",)], "code string")
    assert [r.code for r in catalogues.missing_locale_files(locales, own).collect()] == ["de"]
    catalogues.write_locale_tables(own, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
