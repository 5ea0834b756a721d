"""Stable keys of extracted texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelyard.functions import lookups as L
from babelyard.functions.text import in_data_folder, slug, text_hash
from babelyard.operators.ranks import numbered
from babelyard.sources.scratch import written


def inside_source(path: Column) -> Column:
    """The part after the last src/, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^.*src/", "")


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def with_namespace(rows: DataFrame, path: str = "path") -> DataFrame:
    """Adds namespace: a file's stem; where files share a stem, their folder's name before it; `common` without a path.

    Whether a stem is shared is decided over all paths, so the order of files does not matter. Paths are few
    beside rows: the distinct ones are compared, and their answer is joined back.
    """
    stems = rows.select(F.col(path).alias("__path")).distinct().where("__path is not null and __path <> ''")
    named = stems.select("__path", inside_source(F.col("__path")).alias("__inside"))
    named = named.withColumn("__stem", stem(F.col("__inside"))).withColumn("__folder", F.lower(F.regexp_extract("__inside", r"([^/]+)/[^/]*$", 1)))
    shared = named.groupBy("__stem").agg(F.count_distinct("__inside").alias("__files"))
    prefix = (F.col("__files") > 1) & (F.col("__folder") != "")
    named = named.join(shared, "__stem").select(
        "__path", F.when(prefix, F.concat_ws("_", "__folder", "__stem")).otherwise(F.col("__stem")).alias("namespace")
    )
    joined = rows.join(named, rows[path] == named["__path"], "left").drop("__path")
    return joined.withColumn("namespace", F.coalesce("namespace", F.lit("common")))


def scope_part(name: Column, namespace: Column) -> Column:
    """A function's name with its first letter small; empty if it is the namespace's."""
    small = F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))
    return F.when(F.coalesce(name, F.lit("")) == "", "").when(F.lower(small) == F.lower(namespace), "").otherwise(small)


def role_part(hint: Column, tag: Column, text: Column) -> Column:
    """A comment's hint, else the element's role, else the text's slug, else `text`."""
    role = F.lit(None).cast("string")
    for name, own in reversed(L.ELEMENT_ROLES.items()):
        role = F.when(F.lower(tag) == name, own).otherwise(role)
    return F.coalesce(F.nullif(hint, F.lit("")), role, F.nullif(slug(text), F.lit("")), F.lit("text"))


def base_key(namespace: Column, scope: Column, role: Column) -> Column:
    own = scope_part(scope, namespace)
    return F.concat_ws(".", namespace, F.when(own != "", own), role)


def sibling_index(nodes: DataFrame) -> DataFrame:
    """Adds idx: the number of earlier siblings with the same tag. nodes: path, parent, tag, start."""
    order = Window.partitionBy("path", "parent", "tag").orderBy("start")
    return nodes.withColumn("idx", F.row_number().over(order) - 1)


def collision_counters(rows: DataFrame, group: str, base: str, *order: str) -> DataFrame:
    """Adds key: the base key, with 2, 3, ... from its second row on. Exact where no base key ends like a counted one;
    allocate() covers that too."""
    n = F.row_number().over(Window.partitionBy(group, base).orderBy(*order))
    return rows.withColumn("key", F.concat(F.col(base), F.when(n > 1, n.cast("string")).otherwise("")))


IDENTITY = ["namespace", "path", "text_hash", "ast_sig"]
MAP = "path string, text_hash string, ast_sig string, key string"
#: Longer numbers are no counters.
LONGEST_NUMBER = 15


def _digits(name: Column) -> Column:
    return F.regexp_extract(name, r"([0-9]*)$", 1)


def _readings(names: DataFrame, space: str, name: str) -> DataFrame:
    """space, base, number: every way to read a name as a base key and its counter; 1 stands for the bare key."""
    digits, length = _digits(F.col(name)), F.length(name)
    cut = F.explode(F.sequence(F.lit(0), F.least(F.length(digits), F.lit(LONGEST_NUMBER)))).alias("cut")
    parts = names.select(F.col(space).alias("namespace"), F.col(name).alias("name"), cut)
    counter = F.substr("name", F.length("name") - F.col("cut") + 1)
    number = F.when(F.col("cut") == 0, 1).otherwise(counter.cast("long")).cast("long")
    read = parts.select("namespace", "name", F.substr("name", F.lit(1), F.length("name") - F.col("cut")).alias("base"), number.alias("number"), counter.alias("counter"), "cut")
    return read.where("cut = 0 or (not startswith(counter, '0') and number >= 2)").select("namespace", "base", "number", "name")


def _clashing(bases: DataFrame) -> DataFrame:
    """namespace, base of the base keys that another's counted keys may run into: one is the other with digits behind it."""
    digits = _digits(F.col("base"))
    longer = bases.where(digits != "").select("namespace", F.col("base").alias("longer"), F.explode(F.sequence(F.lit(1), F.length(digits))).alias("cut"))
    shorter = longer.where(F.substring(F.substr("longer", F.length("longer") - F.col("cut") + 1), 1, 1) != "0")
    pairs = shorter.select("namespace", "longer", F.substr("longer", F.lit(1), F.length("longer") - F.col("cut")).alias("base")).join(bases, ["namespace", "base"])
    return pairs.select("namespace", "base").union(pairs.select("namespace", "longer")).distinct()


def _free_counters(new: DataFrame, taken: DataFrame | None) -> DataFrame:
    """new with key: of the rows of a base key, in order, each gets the next number that is not taken.

    With i for a row's place among the new ones and t - j for the j-th taken number t (the free numbers below it), the number
    that a new row gets is its place in both merged by these values, a new row before a taken number that it ties with.
    """
    place = ["path", "pos", "text_hash", "ast_sig"]
    if taken is None:
        counted = numbered(new, ["namespace", "base"], place, "number")
    else:
        held = taken.select("namespace", "base", F.lit(1).alias("held"), "number").dropDuplicates()
        both = new.withColumns({"held": F.lit(0), "number": F.lit(0).cast("long")}).unionByName(held, allowMissingColumns=True)
        ranked = numbered(both, ["namespace", "base", "held"], ["number", *place], "own")
        merged = ranked.withColumn("value", F.when(F.col("held") == 1, F.col("number") - F.col("own")).otherwise(F.col("own"))).drop("number", "own")
        counted = numbered(merged, ["namespace", "base"], ["value", "held"], "number").where("held = 0")
    name = F.concat("base", F.when(F.col("number") > 1, F.col("number").cast("string")).otherwise(""))
    return counted.select(*IDENTITY, name.alias("key"))


CLASH = "namespace string, path string, text_hash string, ast_sig string, key string"


def _in_turn(new: DataFrame, taken: DataFrame | None) -> DataFrame:
    """new with key, for base keys that run into each other: one row after the other. A task streams the sorted rows of
    the bases that differ in their last digits only, and holds one counter a base and the taken names of that stem."""
    stem = lambda c: F.regexp_replace(c, "[0-9]+$", "")
    rows = new.withColumns({"stem": stem(F.col("base")), "held": F.lit(1)})
    if taken is not None:
        names = taken.select("namespace", stem(F.col("name")).alias("stem"), F.col("name").alias("base"), F.lit(0).alias("held")).distinct()
        rows = rows.unionByName(names.join(rows.select("namespace", "stem").distinct(), ["namespace", "stem"], "left_semi"), allowMissingColumns=True)
    order = ["namespace", "stem", "held", "path", "pos", "text_hash", "ast_sig"]

    def give(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, last = None, set(), {}
        for frame in frames:
            out = []
            for space, own, held, path, text, sig, base in zip(*(frame[c] for c in ("namespace", "stem", "held", "path", "text_hash", "ast_sig", "base")), strict=True):
                if (space, own) != at:
                    at, used, last = (space, own), set(), {}
                if not held:
                    used.add(base)
                    continue
                name, n = base, last.get(base, 1)
                if n > 1:
                    name = f"{base}{n}"
                while name in used:
                    n += 1
                    name = f"{base}{n}"
                last[base] = n
                used.add(name)
                out.append((space, path, text, sig, name))
            yield pd.DataFrame(out, columns=[*IDENTITY, "key"])

    return rows.repartition("namespace", "stem").sortWithinPartitions(*order).mapInPandas(give, CLASH)


def allocate(rows: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """namespace, path, pos, text_hash, ast_sig, base_key, key.

    rows: namespace, path, pos, text, ast_sig, base_key, which begins with the namespace. A row that the key map knows keeps its
    key; all keys of the map are taken. New rows get their base key or the first counter that is free,
    in order of path and place; rows of one path, text and signature share a key.

    No namespace and no base key is gathered: free counters follow from row numbers (numbered). Only base keys
    that another's counters may run into (`step` and `step2`) are given out one after the other, stem by stem.
    """
    columns = ["namespace", "path", "pos", "text_hash", "ast_sig", "base_key"]
    own = rows.withColumn("text_hash", text_hash(F.col("text"))).select(*columns)
    if key_map is None:
        own = written(own.withColumn("known", F.lit(None).cast("string")), "keys")
        held = None
    else:
        known = key_map.select("path", "text_hash", "ast_sig", F.col("key").alias("known"))
        own = written(own.join(known, ["path", "text_hash", "ast_sig"], "left").select(*columns, "known"), "keys")
        names = known.select(F.regexp_extract("known", r"^([^.]*)", 1).alias("space"), "known").where("known is not null").distinct()
        held = _readings(names, "space", "known")
    first = own.where("known is null").groupBy(*IDENTITY).agg(F.min(F.struct("pos", "base_key")).alias("f"))
    new = written(first.select(*IDENTITY, F.col("f.pos").alias("pos"), F.col("f.base_key").alias("base")), "keys-new")
    bases = new.select("namespace", "base").distinct()
    clash = written(_clashing(bases), "keys-clash")
    spaces = ["namespace", "base"]
    if clash.isEmpty():
        given = _free_counters(new, held.join(bases, spaces, "left_semi") if held is not None else None)
    else:
        free = bases.join(clash, spaces, "left_anti")
        given = _free_counters(new.join(free, spaces, "left_semi"), held.join(free, spaces, "left_semi") if held is not None else None)
        given = given.unionByName(_in_turn(new.join(clash, spaces, "left_semi"), held))
    given = given.select(*(F.col(c).alias(f"g_{c}") for c in IDENTITY), F.col("key").alias("g_key"))
    same = F.col("known").isNull()
    for c in IDENTITY:
        same &= F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return own.join(given, same, "left").select(*columns, F.coalesce("known", "g_key").alias("key"))


def next_key_map(allocated: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """path, text_hash, ast_sig, key: the old map and what was added."""
    own = allocated.select("path", "text_hash", "ast_sig", "key").distinct()
    return own if key_map is None else own.unionByName(key_map.select(*own.columns)).distinct()


def guard_data_folder(path: Column, value: Column) -> Column:
    """value, or an error for a path in a data folder: keys of data files come from their values only."""
    message = F.concat(F.lit("Data-promoted keys must never be passed to the key generator: "), path)
    return F.when(in_data_folder(path), F.raise_error(message).cast("string")).otherwise(value)
