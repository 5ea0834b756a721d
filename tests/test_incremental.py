"""Incremental runs: extraction of what changed, exactly once."""

from __future__ import annotations

import pytest

from babelyard.plans.lifecycle import Config
from babelyard.streaming.incremental import FORMAT, SyncStore, stream_sync, sync_batch

FILES = "path string, ext string, content string"
APP = "export default function App() {\n  return (\n    <div>\n      <span>Hello World</span>\n    </div>\n  );\n}\n"
CONFIG = Config(languages=["en", "ar"])


@pytest.fixture
def store(spark, tmp_path):
    return SyncStore(spark, f"file://{tmp_path}/state")


def project(spark, app=APP, en="{}", more=()):
    return spark.createDataFrame([("src/App.jsx", ".jsx", app), ("src/i18n/messages/en.json", ".json", en), ("src/i18n/messages/ar.json", ".json", "{}"), *more], FILES)


def messages(store):
    return {(r.locale, r.key): r.value for r in store.read("messages").collect()}


def source(store, path="src/App.jsx"):
    return {r.path: r.content for r in store.read("sources").collect()}.get(path)


def test_texts_are_wrapped_and_locales_seeded(spark, store):
    assert sync_batch(project(spark), store, 0, CONFIG)
    held = messages(store)
    (key,) = {k for _, k in held}
    assert held == {("en", key): "Hello World", ("ar", key): ""}
    assert f't("{key}")' in source(store) or f"t('{key}')" in source(store)


def test_second_run_without_changes_does_nothing(spark, store):
    sync_batch(project(spark), store, 0, CONFIG)
    done = project(spark, source(store))
    assert not sync_batch(done, store, 1, CONFIG)
    assert store.committed() == [0]


def test_changes_are_found_by_content(spark, store):
    sync_batch(project(spark), store, 0, CONFIG)
    before = messages(store)
    edited = source(store).replace("</span>", "</span><p>Brand New Text</p>")
    assert sync_batch(project(spark, edited), store, 1, CONFIG)
    after = messages(store)
    assert before.items() < after.items() and "Brand New Text" in after.values()


def test_state_of_another_format_counts_for_nothing(spark, store, tmp_path):
    (tmp_path / "state" / "mtime-1").mkdir(parents=True)
    (tmp_path / "state" / "mtime-1" / "last").write_text("1700000000000")
    assert sync_batch(project(spark), store, 0, CONFIG)
    assert len(messages(store)) == 2 and (tmp_path / "state" / f"{FORMAT}-commits").exists()


def test_a_batch_counts_once(spark, store):
    sync_batch(project(spark), store, 5, CONFIG)
    kept = store.attempt(5)
    assert not sync_batch(project(spark, APP.replace("Hello", "Other")), store, 5, CONFIG)
    assert not store.commit(5, {n: store.read(n) for n in store.TABLES})
    assert store.attempt(5) == kept and ("en", "Other World") not in messages(store).items()


def test_an_attempt_that_fails_leaves_nothing_to_read(spark, store):
    sync_batch(project(spark), store, 0, CONFIG)
    before = messages(store)
    tables = {n: store.read(n) for n in store.TABLES}
    tables["sources"] = tables["sources"].selectExpr("path", "raise_error('broken') as content")
    with pytest.raises(Exception, match="broken"):
        store.commit(1, tables)
    assert store.committed() == [0] and messages(store) == before


def test_files_that_are_gone_are_forgotten(spark, store):
    more = [("src/B.jsx", ".jsx", APP.replace("Hello", "Good"))]
    sync_batch(project(spark, more=more), store, 0, CONFIG)
    assert {r.path for r in store.read("files").collect()} == {"src/App.jsx", "src/B.jsx"}
    sync_batch(project(spark, APP.replace("World", "Moon")), store, 1, CONFIG)
    assert {r.path for r in store.read("files").collect()} == {"src/App.jsx"}
    assert "Good World" in messages(store).values()


def test_kept_messages_and_texts_of_message_files(spark, store):
    sync_batch(project(spark, en='{"old": "kept"}'), store, 0, CONFIG)
    assert messages(store)["en", "old"] == "kept" and ("ar", "old") not in messages(store)


def test_arriving_files(spark, store, tmp_path):
    folder = tmp_path / "in" / "src"
    folder.mkdir(parents=True)
    (folder / "A.jsx").write_text(APP)
    run = lambda: stream_sync(spark, f"file://{tmp_path}/in", store, CONFIG, f"file://{tmp_path}/check").awaitTermination()
    run()
    (folder / "B.jsx").write_text(APP.replace("Hello", "Good"))
    run()
    assert store.committed() == [0, 1] and {r.path for r in store.read("files").collect()} == {"src/A.jsx", "src/B.jsx"}
    assert {v for (l, _), v in messages(store).items() if l == "en"} == {"Hello World", "Good World"}
    run()
    assert store.committed() == [0, 1]


def test_tables_of_a_new_store_ask_for_no_python_worker(spark, store):
    """They have no rows, and their plans know it: no task makes them."""
    for name, schema in SyncStore.TABLES.items():
        own = store.read(name)
        assert own.schema == spark.createDataFrame([], schema).schema and own.count() == 0
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert "RDD" not in plan and "<empty>" in plan
