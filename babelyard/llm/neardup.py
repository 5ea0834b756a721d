"""N-gram Jaccard join: MinHash buckets, Bayesian pruning of pairs, exact verification.

The join is worked out between sets of shingles, not documents: documents with equal sets form
one set with a member count. Links between sets are found without listing the pairs of a bucket:

1. In every bucket each set meets the bucket's least set only (as many pairs as rows). What is
   similar is linked, and the links' components are taken.
2. Only buckets whose sets lie in several components can hide a link that joins two of them. Their sets are
   compared pair by pair inside tasks, in blocks of bounded size; a task verifies what passes the pruning
   and returns only links between components that it has not linked yet.
3. If asked for, the links of every set are counted: a component is cut into blocks of bounded size, and
   each block adds the members of similar sets, so a large group gives counts and not pairs. What a block gets of a
   set is its MinHash values and how it differs from the component's root: a near copy differs little, however long it is.

A pair is compared MinHash value by value, STEP at a time, and dropped as soon as the posterior
probability that its similarity reaches the threshold is below tolerance; all others are verified on their exact sets.
Texts are read twice, once for the MinHash values and once, where a set shares a bucket, for its hashed shingles.
A bucket, class or root that holds most rows is dealt over many parts in every join (tables.spread_join).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelyard.llm import shingles, workers
from babelyard.llm.components import connected_components
from babelyard.llm.tables import materialise, materialise_counted, spread_join

BANDS, ROWS = 26, 5
STEP = 10
TOLERANCE = 1e-6
#: A block's rows and bytes are at most twice these.
CHUNK_ROWS, CHUNK_BYTES = 1024, 8 << 20
#: In place of a null doc_id where the least is sought.
LAST_ID = 2**63 - 1
#: doc_id as text: whole numbers beside nulls would become floating ones on their way.
SETS = "doc_id string, content long, k1 long, k2 long, n_shingles long, signature binary"
DIFFERENCE = "rep long, comp long, n_docs long, signature binary, differs binary, missing long, size long, root_size long"


@lru_cache
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of `compared` with which a pair stays.

    With a uniform prior, after m equal values of n the similarity follows Beta(m + 1, n - m + 1),
    and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def prune(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs (rows a, rows b) stay after all values."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), dtype=np.int32)
    for at in range(0, signatures.shape[1], STEP):
        end = min(at + STEP, signatures.shape[1])
        equal[alive] += (signatures[a[alive], at:end] == signatures[b[alive], at:end]).sum(axis=1, dtype=np.int32)
        alive = alive[equal[alive] >= least_matches(end, threshold, tolerance)]
    return alive


def describe(frames):
    """For mapInPandas: (doc_id, content, text) to SETS. No words: k1 is null."""
    workers.release()
    a, b = shingles.parameters(BANDS * ROWS)
    for frame in frames:
        rows = []
        for doc_id, content, text in zip(frame["doc_id"], frame["content"], frame["text"], strict=True):
            own = shingles.shingle_set(text if isinstance(text, str) else None)
            if not len(own):
                rows.append((doc_id, content, None, None, 0, None))
                continue
            key = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype="<i8")
            rows.append((doc_id, content, int(key[0]), int(key[1]), len(own), shingles.minhash(own, a, b).tobytes()))
        got = dict(zip((c.split()[0] for c in SETS.split(", ")), zip(*rows, strict=True) if rows else [()] * 6, strict=True))
        whole = {c: pd.array(list(got[c]), dtype="Int64") for c in ("k1", "k2")}
        yield pd.DataFrame({c: whole.get(c, list(got[c])) for c in got})


def _matrix(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype=np.uint32).reshape(-1, BANDS * ROWS)


def _set(hashes: bytes) -> np.ndarray:
    return np.frombuffer(hashes, dtype=np.uint64)


def band_keys(frames):
    """For mapInPandas: (rep, signature) to the keys of its buckets."""
    for frame in frames:
        if not len(frame):
            continue
        values = _matrix(frame["signature"]).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        key = np.repeat(key, len(values), axis=0)
        with np.errstate(over="ignore"):
            for k in range(ROWS):
                key = shingles._mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
        yield pd.DataFrame({"rep": frame["rep"], "keys": list(key.view(np.int64))})


def chunks(rows: Column, size: Column, chunk_rows: int) -> Column:
    """In how many parts a group of so many rows and bytes is cut."""
    return F.greatest(F.ceil(rows / chunk_rows), F.ceil(size / CHUNK_BYTES), F.lit(1)).cast("int").alias("chunks")


def deal_blocks(df: DataFrame) -> DataFrame:
    """Deals every row of a group (its number of `chunks` beside it) to all blocks, pairs of chunks, that its chunk is in:
    one for a small group."""
    dealt = df.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(23)), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("other", "chunks")


def _whole_blocks(frames, keys: list[str], rows: int = 20_000):
    """Joins and cuts the frames of a sorted partition so that each holds whole blocks."""
    held: list[pd.DataFrame] = []
    count = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        count += len(frame)
        if count < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = (whole[keys] == whole[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield whole.iloc[:cut]
        held, count = [whole.iloc[cut:]], len(whole) - cut
    if count:
        yield pd.concat(held, ignore_index=True)


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
    new[0] = True
    return np.flatnonzero(new)


def _first_shared_band(signatures: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    equal = (signatures[a] == signatures[b]).reshape(-1, BANDS, ROWS).all(axis=2)
    return np.argmax(equal, axis=1)


def link_components(threshold: float, tolerance: float):
    """For mapInPandas over sorted blocks of buckets: verified links (a, b) that join components.

    A pair that shares several buckets is looked at in the first of them only.
    """
    keys = ["key", "low", "high"]

    def run(frames):
        for frame in _whole_blocks(frames, keys, 4_000):
            starts = _starts(frame, keys)
            ends = np.repeat(np.append(starts[1:], len(frame)), np.diff(np.append(starts, len(frame))))
            signatures = _matrix(frame["signature"])
            rep, comp, chunk, band = (frame[c].to_numpy() for c in ("rep", "comp", "chunk", "band"))
            same = frame["low"].to_numpy() == frame["high"].to_numpy()
            sets, root = frame["hashes"].to_numpy(), {}

            def find(x, root=root):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            at, step, found = np.arange(len(frame)), 1, []
            while len(at := at[at + step < ends[at]]):
                a, b = at, at + step
                pick = (comp[a] != comp[b]) & (same[a] | (chunk[a] != chunk[b]))
                a, b = a[pick], b[pick]
                left = prune(signatures, a, b, threshold, tolerance)
                a, b = a[left], b[left]
                if len(a):
                    first = _first_shared_band(signatures, a, b) == band[a]
                    for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
                        p, q = find(comp[x]), find(comp[y])
                        if p != q and shingles.jaccard(_set(sets[x]), _set(sets[y])) >= threshold:
                            root[max(p, q)] = min(p, q)
                            found.append((rep[x], rep[y]))
                step += 1
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def likely(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """prune() of all pairs of two tables of signatures, as a matrix."""
    alive = np.ones((len(left), len(right)), dtype=bool)
    equal = np.zeros(alive.shape, dtype=np.int16)
    for at in range(0, left.shape[1], STEP):
        end = min(at + STEP, left.shape[1])
        if 3 * np.count_nonzero(alive) > alive.size:
            for k in range(at, end):
                equal += left[:, k, None] == right[None, :, k]
            alive &= equal >= least_matches(end, threshold, tolerance)
        else:
            a, b = np.nonzero(alive)
            equal[a, b] += (left[a, at:end] == right[b, at:end]).sum(axis=1, dtype=np.int16)
            alive[a, b] = equal[a, b] >= least_matches(end, threshold, tolerance)
    return alive


def common_members(sets: list[np.ndarray], split: int, width: int = 2048) -> np.ndarray:
    """How many members each of the first `split` sets shares with each of the others (with each of all sets, if split is 0)."""
    sizes = [len(x) for x in sets]
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1  # what one set alone has is common to no pair
    place = np.cumsum(shared) - 1
    picked = shared[where]
    owner, where = owner[picked], place[where[picked]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    out = np.zeros((split or len(sets), len(sets) - split))
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(where, [low, low + width])
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[owner[a:b], where[a:b] - low] = 1.0
        out += dense[: split or None] @ dense[split:].T
    return out


def near_pairs(part: pd.DataFrame, split: int, threshold: float, tolerance: float, strip: int = 256) -> np.ndarray:
    """Which of the first `split` rows of one component are similar to which of the others (of all rows, if split is 0).

    With x the members of a set that the root lacks and of the root that it lacks, and m how many the latter are, two sets share
    (root's size) - m - m' + |x & x'| members.
    """
    signatures, differs = _matrix(part["signature"]), [_set(x) for x in part["differs"]]
    size, missing = part["size"].to_numpy(np.float64), part["missing"].to_numpy(np.float64)
    end = split or len(part)
    alive = np.vstack([likely(signatures[at : min(at + strip, end)], signatures[split:], threshold, tolerance) for at in range(0, end, strip)])
    common = float(part["root_size"].iloc[0]) - missing[:end, None] - missing[None, split:] + common_members(differs, split)
    near = alive & (common >= threshold * (size[:end, None] + size[None, split:] - common) - 1e-9)
    if not split:
        np.fill_diagonal(near, False)
    return near


def count_links(threshold: float, tolerance: float):
    """For mapInPandas over sorted blocks of components (DIFFERENCE): rep, and the members of the sets similar to it."""
    keys = ["comp", "low", "high"]

    def block(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n_docs = part["n_docs"].to_numpy(np.int64)
        if part["low"].iloc[0] == part["high"].iloc[0]:
            return part["rep"].to_numpy(), near_pairs(part, 0, threshold, tolerance) @ n_docs
        first = (part["chunk"] == part["low"]).to_numpy()
        part, n_docs = pd.concat([part[first], part[~first]], ignore_index=True), np.concatenate([n_docs[first], n_docs[~first]])
        split = int(first.sum())
        if split in (0, len(part)):
            return part["rep"].to_numpy(), np.zeros(len(part), dtype=np.int64)
        near = near_pairs(part, split, threshold, tolerance)
        return part["rep"].to_numpy(), np.concatenate([near @ n_docs[split:], n_docs[:split] @ near])

    def run(frames):
        for frame in _whole_blocks(frames, keys, 2_000):
            starts = np.append(_starts(frame, keys), len(frame))
            counted = [block(frame.iloc[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            yield pd.DataFrame({"rep": np.concatenate([x[0] for x in counted]), "links": np.concatenate([x[1] for x in counted])})

    return run


def shingled(frames):
    """For mapInPandas: (rep, n_docs, signature, times, text) to rep, n_docs, signature, times, hashes."""
    for frame in frames:
        hashes = [shingles.shingle_set(t).tobytes() for t in frame["text"]]
        yield frame[["rep", "n_docs", "signature"]].assign(times=frame["times"].astype("Int64"), hashes=hashes)


def differences(frames):
    """For mapInPandas: (rep, comp, n_docs, signature, hashes, root_hashes) to DIFFERENCE."""
    for frame in frames:
        own, root = [_set(x) for x in frame["hashes"]], [_set(x) for x in frame["root_hashes"]]
        out = frame[["rep", "comp", "n_docs", "signature"]].copy()
        out["differs"] = [np.setxor1d(a, b, assume_unique=True).tobytes() for a, b in zip(own, root, strict=True)]
        out["size"], out["root_size"] = [len(x) for x in own], [len(x) for x in root]
        # members that either lacks: those of the root are as many more as the root is larger
        out["missing"] = (out["differs"].map(len) // 8 + out["root_size"] - out["size"]) // 2
        yield out[[c.split()[0] for c in DIFFERENCE.split(", ")]]


class JaccardJoin:
    """The steps of the join over one table of documents; see the module's text."""

    def __init__(self, docs: DataFrame, threshold: float = 0.8, tolerance: float = TOLERANCE, chunk_rows: int = CHUNK_ROWS):
        self.docs, self.threshold, self.tolerance, self.chunk_rows = docs, threshold, tolerance, chunk_rows
        workers.bound_batches(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
        described = rows.mapInPandas(describe, SETS).withColumn("doc_id", F.col("doc_id").cast("long"))
        # numbers are kept with their tables, so they stay whatever is computed again
        self.rows = materialise(described.withColumn("number", F.monotonically_increasing_id()), "jaccard-rows")
        first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "content")).alias("first")
        sets = self.rows.where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), first, F.first("signature").alias("signature"))
        self.sets = materialise(sets.withColumn("rep", F.monotonically_increasing_id()), "jaccard-sets")

    def find_buckets(self) -> tuple[DataFrame, DataFrame]:
        """(key, band, rep, lead of the rows of buckets that hold several sets; key, lead, n of the buckets). lead: the least set."""
        keyed = self.sets.select("rep", "signature").mapInPandas(band_keys, "rep long, keys array<long>")
        keyed = materialise(keyed.select("rep", F.posexplode("keys").alias("band", "key")), "jaccard-keys")
        found = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
        shared, seen = materialise_counted(found, "jaccard-shared", total=F.sum("n"))
        return materialise(spread_join(keyed, shared.drop("n"), "key", "rep", counts=shared, total=seen["total"] or 0), "jaccard-buckets"), shared

    def read_sets(self, buckets: DataFrame) -> DataFrame:
        """rep, n_docs, signature, hashes of every set that shares a bucket: the one time that texts are dealt by key. Rows that
        repeat a document are dealt over many parts and give equal rows, of which one is kept."""
        key = F.struct("id", "content").alias("key")
        repeated = self.rows.groupBy(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "content").agg(F.count("*").alias("times")).where("times > 1")
        repeated = materialise(repeated.select(key, "times"), "jaccard-repeated")
        wanted = self.sets.join(buckets.select("rep").distinct(), "rep", "left_semi")
        wanted = wanted.select("rep", "n_docs", "signature", F.col("first.doc_id").alias("id"), F.col("first.content").alias("content"))
        wanted = wanted.select("rep", "n_docs", "signature", key).join(repeated, "key", "left")
        rows = self.docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("content"), "text", F.monotonically_increasing_id().alias("row"))
        got = spread_join(rows.select(key, "text", "row"), wanted, "key", "row", counts=repeated.withColumnRenamed("times", "n"))
        table = materialise(got.select("rep", "n_docs", "signature", "times", "text").mapInPandas(shingled, "rep long, n_docs long, signature binary, times long, hashes binary"), "jaccard-hashes")
        return table.where("times is null").unionByName(table.where("times is not null").dropDuplicates(["rep"])).drop("times")

    def verify(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The pairs (a, b) that stay after pruning and whose exact similarity reaches the threshold. Many pairs may share b."""
        threshold, tolerance = self.threshold, self.tolerance

        def drop(frames):
            for frame in frames:
                if len(frame):
                    both = np.vstack([_matrix(frame["signature_a"]), _matrix(frame["signature_b"])])
                    n = len(frame)
                    left = prune(both, np.arange(n), np.arange(n, 2 * n), threshold, tolerance)
                    yield frame.iloc[left][["a", "b"]]

        def exact(frames):
            for frame in frames:
                near = [shingles.jaccard(_set(x), _set(y)) >= threshold for x, y in zip(frame["hashes_a"], frame["hashes_b"], strict=True)]
                yield frame.loc[near, ["a", "b"]]

        def beside(own: DataFrame, column: str) -> DataFrame:
            of = lambda end: held.select(F.col("rep").alias(end), F.col(column).alias(f"{column}_{end}"))
            return spread_join(own, of("b"), "b", "a").join(of("a"), "a").select("a", "b", f"{column}_a", f"{column}_b")

        pairs = materialise(pairs, "jaccard-pairs")
        pairs = materialise(beside(pairs, "signature").mapInPandas(drop, "a long, b long"), "jaccard-candidates")
        return materialise(beside(pairs, "hashes").mapInPandas(exact, "a long, b long"), "jaccard-links")

    def crossing_links(self, buckets: DataFrame, shared: DataFrame, components: DataFrame, held: DataFrame) -> DataFrame:
        """Verified links between sets that share a bucket and lie in different components."""
        sized = held.select("rep", (F.octet_length("hashes") + F.octet_length("signature")).cast("long").alias("bytes"))
        placed = sized.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("comp"), "bytes")
        named = buckets.select("key", "band", "rep").join(placed, "rep")
        ends = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("x < y")
        mixed, seen = materialise_counted(ends.select("key", "n", chunks(F.col("n"), F.col("bytes"), self.chunk_rows)), "jaccard-mixed", total=F.sum("n"))
        if not seen["total"]:
            return components.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
        rows = spread_join(named.drop("bytes"), mixed.drop("n"), "key", "rep", counts=mixed.select("key", "n"), total=seen["total"]).join(held.drop("n_docs"), "rep")
        parts = deal_blocks(rows).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        columns = ["key", "low", "high", "chunk", "band", "rep", "comp", "signature", "hashes"]
        return parts.select(*columns).mapInPandas(link_components(self.threshold, self.tolerance), "a long, b long").distinct()

    def links_of(self, components: DataFrame, held: DataFrame) -> DataFrame:
        """rep, links: documents of other sets that are similar to it."""
        sizes, seen = materialise_counted(components.groupBy(F.col("root").alias("comp")).agg(F.count("*").alias("n")), "jaccard-sizes", total=F.sum("n"))
        total = seen["total"] or 0
        members = components.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(held, "rep")
        roots = components.where("node = root").select(F.col("root").alias("comp")).join(held.select(F.col("rep").alias("comp"), F.col("hashes").alias("root_hashes")), "comp")
        beside = spread_join(members, roots, "comp", "rep", counts=sizes, total=total)
        differ = materialise(beside.select("rep", "comp", "n_docs", "signature", "hashes", "root_hashes").mapInPandas(differences, DIFFERENCE), "jaccard-differences")
        size = F.sum(F.octet_length("differs") + F.octet_length("signature"))
        cut = materialise(differ.groupBy("comp").agg(F.count("*").alias("n"), size.alias("bytes")).select("comp", chunks(F.col("n"), F.col("bytes"), self.chunk_rows)), "jaccard-cuts")
        dealt = deal_blocks(spread_join(differ, cut, "comp", "rep", counts=sizes, total=total))
        parts = dealt.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high")
        columns = ["comp", "low", "high", "chunk", "rep", "n_docs", "signature", "differs", "missing", "size", "root_size"]
        counted = parts.select(*columns).mapInPandas(count_links(self.threshold, self.tolerance), "rep long, links long")
        return counted.groupBy("rep").agg(F.sum("links").alias("links"))

    def run(self, with_links: bool = True) -> DataFrame:
        """doc_id, content, class_key, class_id, n_copies, n_links (if asked for) of every row. class_key: a number
        that the rows of a class share; null for a row without words."""
        buckets, shared = self.find_buckets()
        held = self.read_sets(buckets)
        starred = self.verify(buckets.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), held)
        parts = connected_components(starred, "a", "b")
        crossing = materialise(self.crossing_links(buckets, shared, parts, held), "jaccard-crossing")
        if not crossing.isEmpty():
            parts = connected_components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).union(crossing), "a", "b")
        parts = materialise(parts, "jaccard-parts")
        grouped = self.sets.select("rep", "k1", "k2", "n_docs", F.col("first.doc_id").alias("own")).join(parts, F.col("rep") == F.col("node"), "left")
        grouped = materialise(grouped.drop("node"), "jaccard-grouped")
        roots = grouped.where("root is not null").groupBy("root").agg(F.min("own").alias("least"))
        named = spread_join(grouped.where("root is not null"), materialise(roots, "jaccard-roots"), "root", "rep")
        named = named.unionByName(grouped.where("root is null").withColumn("least", F.col("own")))
        named = named.select(F.struct("k1", "k2").alias("k"), "n_docs", "rep", F.coalesce("root", "rep").alias("class_key"), F.col("least").alias("class_id"))
        if with_links:
            named = named.join(self.links_of(parts, held), "rep", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1)
        else:
            named = named.withColumn("n_links", F.lit(None).cast("long"))
        copies = self.sets.select(F.struct("k1", "k2").alias("k"), F.col("n_docs").alias("n"))
        rows = self.rows.where("k1 is not null").select("doc_id", "content", "number", F.struct("k1", "k2").alias("k"))
        out = spread_join(rows, named, "k", "number", counts=copies).select(
            "doc_id", "content", "class_key", F.nullif("class_id", F.lit(LAST_ID)).alias("class_id"), F.col("n_docs").alias("n_copies"), "n_links"
        )
        alone = self.rows.where("k1 is null").select(
            "doc_id", "content", F.lit(None).cast("long").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")
        )
        return out.unionByName(alone)


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = TOLERANCE, with_links: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, content, class_id, n_copies, n_links.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles is at least
    threshold; class_id is the least doc_id that links lead to, n_links the number of other documents linked
    directly, n_copies how many documents have the same set. Words are runs of letters, digits and
    non-ASCII characters in lower case. A text of fewer than five words is one shingle; a null text, or one without words, is
    linked to none and is a class of its own. Repeated rows are copies of each other. Rows with a null doc_id take part;
    a class of only such rows has a null class_id. An empty table gives no rows.
    """
    return JaccardJoin(docs, threshold, tolerance).run(with_links).drop("class_key")


def has_words(text: Column) -> Column:
    """Whether a text has a word as shingles know it."""
    return F.coalesce(F.rlike(text, F.lit(r"[0-9A-Za-z]|[^\x00-\x7F]")), F.lit(False))


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, of several texts with that id the least by hash.

    Null ids come last. Of rows that repeat an id and its text one stays. Rows without words are classes of their own, so all of
    them stay but repeats of an id that isn't null; an empty table gives no rows. The columns stay, whatever their names.
    """
    classes = materialise(JaccardJoin(docs, threshold).run(with_links=False).where("class_key is not null"), "jaccard-classes")
    rows = classes.groupBy("class_key", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "content").agg(F.count("*").alias("times"))
    chosen = rows.groupBy("class_key").agg(F.min(F.struct("id", "content", "times")).alias("c"))
    # names that no table of documents has
    kept = chosen.select(F.col("c.id").alias("__kept_id"), F.col("c.content").alias("__kept_content"), F.col("c.times").alias("__times"))
    kept = materialise(kept, "jaccard-kept")
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID))
    marked = docs.where(has_words(docs["text"])).join(kept, (own == F.col("__kept_id")) & (F.xxhash64(docs["text"]) == F.col("__kept_content")))
    once = marked.where("__times = 1").select(*docs.columns)
    repeated = marked.where("__times > 1").dropDuplicates(["__kept_id", "__kept_content"]).select(*docs.columns)
    wordless = docs.where(~has_words(docs["text"]))
    named = wordless.where(docs["doc_id"].isNotNull()).withColumn("__content", F.xxhash64(docs["text"])).withColumn("__id", docs["doc_id"])
    named = named.dropDuplicates(["__id", "__content"]).select(*docs.columns)
    return once.unionByName(repeated).unionByName(named).unionByName(wordless.where(docs["doc_id"].isNull()))
