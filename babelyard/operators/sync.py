"""Comparison of message catalogues: messages(locale, key, value), valid keys(key), snapshots of data values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelyard.sources.scratch import written

RESERVED = "_deprecated"


def valid_keys(static_keys: DataFrame, data_values: DataFrame) -> DataFrame:
    """key: what calls name, and what data files hold."""
    return static_keys.select("key").union(data_values.select(F.col("value").alias("key"))).where("key is not null").distinct()


def _of(messages: DataFrame, locale: str) -> DataFrame:
    return messages.where(F.col("locale") == locale)


def new_keys(valid: DataFrame, messages: DataFrame, default: str) -> DataFrame:
    return valid.select("key").distinct().join(_of(messages, default), "key", "left_anti")


def orphan_keys(valid: DataFrame, messages: DataFrame, default: str) -> DataFrame:
    return _of(messages, default).where(F.col("key") != RESERVED).select("key").join(valid, "key", "left_anti")


def _in_each(keys: DataFrame, locales: list[str]) -> DataFrame:
    """Each row once for every locale; the locales are a project's list, a few dozen at most."""
    names = F.array(*(F.lit(x) for x in locales)) if locales else F.array().cast("array<string>")
    return keys.withColumn("locale", F.explode(names))


def coverage_cells(valid: DataFrame, messages: DataFrame, locales: list[str], default: str) -> DataFrame:
    """locale, key, present, filled for every other locale and every valid key of the default one."""
    keys = _of(messages, default).select("key").distinct().join(valid, "key", "left_semi")
    cells = _in_each(keys, sorted({x for x in locales if x != default}))
    there = messages.where(F.col("locale") != default).groupBy("locale", "key").agg(F.max(F.coalesce(F.col("value"), F.lit("")) != "").alias("filled"))
    found = cells.join(there, ["locale", "key"], "left")
    return found.select("locale", "key", F.col("filled").isNotNull().alias("present"), F.coalesce("filled", F.lit(False)).alias("filled"))


def missing_keys(valid: DataFrame, messages: DataFrame, locales: list[str], default: str) -> DataFrame:
    return coverage_cells(valid, messages, locales, default).where("not present").select("locale", "key")


def coverage(cells: DataFrame) -> DataFrame:
    """locale (null: all), total, covered, filled, percent; 100 where nothing is to be covered.
    A key counts as covered if it is there, as filled if its value is not empty."""
    out = cells.rollup("locale").agg(F.count("key").alias("total"), F.count_if("present").alias("covered"), F.count_if("filled").alias("filled"))
    percent = F.when(F.col("total") == 0, 100.0).otherwise(100.0 * F.col("covered") / F.col("total"))
    return out.select("locale", "total", "covered", "filled", percent.alias("percent"))


def reconcile(valid: DataFrame, messages: DataFrame, locales: list[str], default: str, threshold: float = 100.0, prune: bool = False) -> DataFrame:
    """One row: n_new, n_orphans, n_missing, total, covered, percent, ok. Reads only.

    A threshold of 0 counts as unset, that is 100; with prune, orphans don't count against the catalogue.
    """
    cells = coverage_cells(valid, messages, locales, default).select(F.when(F.col("present"), "covered").otherwise("missing").alias("kind"))
    orphans = orphan_keys(valid, messages, default).select(F.lit("orphan").alias("kind"))
    new = new_keys(valid, messages, default).select(F.lit("new").alias("kind"))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    row = cells.union(orphans).union(new).agg(
        count("new").alias("n_new"), count("orphan").alias("n_orphans"), count("missing").alias("n_missing"), count("covered").alias("covered")
    )
    total = F.col("covered") + F.col("n_missing")
    percent = F.when(total == 0, 100.0).otherwise(100.0 * F.col("covered") / total)
    ok = (percent >= (threshold or 100.0)) & ((F.col("n_orphans") == 0) | F.lit(prune))
    return row.select("n_new", "n_orphans", "n_missing", total.alias("total"), "covered", F.round(percent, 2).alias("percent"), ok.alias("ok"))


def value_edits(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, dot_path, old_key, new_key: values that changed in place, where the old value is gone everywhere and the new one was nowhere before."""
    old, new = previous.select("path", "dot_path", F.col("value").alias("old_key")), current.select("path", "dot_path", F.col("value").alias("new_key"))
    changed = old.join(new, ["path", "dot_path"]).where("old_key <> '' and old_key <> new_key")
    # the values that are looked for are dealt by their hashes, so no text of the whole snapshots moves
    hashed = lambda df, name: df.select(F.sha2("value", 256).alias(name)).distinct()
    changed = changed.withColumn("old_hash", F.sha2("old_key", 256)).withColumn("new_hash", F.sha2("new_key", 256))
    gone = changed.join(hashed(current, "old_hash"), "old_hash", "left_anti")
    return gone.join(hashed(previous, "new_hash"), "new_hash", "left_anti").select("path", "dot_path", "old_key", "new_key")


def history_edits(snapshots: DataFrame) -> DataFrame:
    """old_key, new_key, step of values that changed in place from a snapshot to the next one, as value_edits has it for two.
    snapshots: step, path, dot_path, value; step is a snapshot's number, and the next one's is greater by one."""
    old = snapshots.select("step", "path", "dot_path", F.col("value").alias("old_key"))
    new = snapshots.select((F.col("step") - 1).alias("step"), "path", "dot_path", F.col("value").alias("new_key"))
    changed = old.join(new, ["step", "path", "dot_path"]).where("old_key <> '' and old_key <> new_key")
    # the values that are looked for are dealt by their hashes, so no text of the whole snapshots moves
    held = snapshots.select("step", F.sha2("value", 256).alias("hash")).distinct()
    changed = changed.withColumn("old_hash", F.sha2("old_key", 256)).withColumn("new_hash", F.sha2("new_key", 256))
    gone = changed.join(held.select((F.col("step") - 1).alias("step"), F.col("hash").alias("old_hash")), ["step", "old_hash"], "left_anti")
    fresh = gone.join(held.select("step", F.col("hash").alias("new_hash")), ["step", "new_hash"], "left_anti")
    return fresh.groupBy("step", "old_key").agg(F.max("new_key").alias("new_key"))


def moved_keys(edits: DataFrame) -> DataFrame:
    """old_key, new_key: where each key has moved to in the end, over edits of many snapshots (old_key, new_key, step).

    A move goes on with the first later move of its new key. Moves point to that one, and pointers are followed by
    doubling: as many rounds as the logarithm of the longest chain. A key that comes back to its own name isn't moved.
    """
    moves = written(edits.select("step", "old_key", "new_key").groupBy("step", "old_key").agg(F.max("new_key").alias("new_key")), "moves")
    # of each key and step one arrival, however many keys moved there
    events = moves.select(F.col("new_key").alias("key"), "step", F.lit(None).cast(moves.schema["step"].dataType).alias("leaves")).distinct()
    events = events.unionByName(moves.select(F.col("old_key").alias("key"), "step", F.col("step").alias("leaves")))
    later = Window.partitionBy("key").orderBy("step").rangeBetween(1, Window.unboundedFollowing)
    after = events.withColumn("next", F.min("leaves").over(later)).where("leaves is null").select(F.col("key").alias("new_key"), "step", "next")
    table = written(moves.join(after, ["new_key", "step"]).select("old_key", "step", "new_key", "next"), "moves")
    while not table.where("next is not null").isEmpty():
        on = table.select(F.col("old_key").alias("via"), F.col("step").alias("at"), F.col("new_key").alias("onto"), F.col("next").alias("then"))
        joined = table.join(on, (F.col("new_key") == F.col("via")) & (F.col("next") == F.col("at")), "left")
        table = written(joined.select("old_key", "step", F.coalesce("onto", "new_key").alias("new_key"), F.col("then").alias("next")), "moves")
    return table.groupBy("old_key").agg(F.min_by("new_key", "step").alias("new_key")).where("old_key <> new_key")


def migrate(messages: DataFrame, edits: DataFrame, default: str) -> DataFrame:
    """messages with edited keys renamed: translations move to the new key, in the default locale the new text is the value.
    A key that already stands under the new name gives way to the moved one."""
    renames = edits.groupBy("old_key").agg(F.max("new_key").alias("new_key"))
    joined = messages.join(renames, messages["key"] == renames["old_key"], "left")
    value = F.when(F.col("new_key").isNotNull() & (F.col("locale") == default), F.col("new_key")).otherwise(F.col("value"))
    moved = joined.select("locale", F.coalesce("new_key", "key").alias("key"), value.alias("value"), F.col("new_key").isNotNull().alias("moved"))
    return moved.groupBy("locale", "key").agg(F.max_by("value", F.struct("moved", "value")).alias("value"))


def insert_only(messages: DataFrame, additions: DataFrame) -> DataFrame:
    """messages and those additions whose (locale, key) is not there."""
    fresh = additions.select("locale", "key", "value").dropDuplicates(["locale", "key"]).join(messages, ["locale", "key"], "left_anti")
    return messages.select("locale", "key", "value").unionByName(fresh)


def seed_locales(messages: DataFrame, extracted: DataFrame, locales: list[str], default: str) -> DataFrame:
    """Extracted (key, value) in every locale where the key is absent: the text in the default one, empty in others."""
    spread = _in_each(extracted.select("key", "value"), locales)
    return insert_only(messages, spread.withColumn("value", F.when(F.col("locale") == default, F.col("value")).otherwise("")))


def write_back(messages: DataFrame, valid: DataFrame, default: str, prune: bool = False) -> DataFrame:
    """The default locale with new keys as their own value; with prune, without its orphans."""
    new = new_keys(valid, messages, default).select(F.lit(default).alias("locale"), "key", F.col("key").alias("value"))
    out = messages.select("locale", "key", "value").unionByName(new)
    if not prune:
        return out
    gone = orphan_keys(valid, messages, default).select(F.lit(default).alias("locale"), "key")
    return out.join(gone, ["locale", "key"], "left_anti")


def last_wins(extracted: DataFrame, order: tuple[str, ...] = ("file_order", "ordinal")) -> DataFrame:
    """key, value: of repeated keys the last in order."""
    return extracted.groupBy("key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def deep_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """locale, key, value: new values over old ones."""
    both = old.select("locale", "key", F.col("value").alias("before")).join(new.select("locale", "key", F.col("value").alias("after")), ["locale", "key"], "full")
    return both.select("locale", "key", F.coalesce("after", "before").alias("value"))


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose (path, SHA-256) is not in the state; contents are hashed where they are read and don't take part in the join's key."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(state.select("path", "sha256"), ["path", "sha256"], "left_anti")


def next_state(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))
