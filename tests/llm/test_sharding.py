from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import xxhash

from babelyard.llm import sharding


def test_bytes_are_near_equal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard_documents(docs, n_shards=10).collect()
    assert len(rows) == len(texts)
    held, places = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        held[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(held.values()) <= 1.05 * sum(held.values()) / 10


def test_hot_text_is_split_and_others_stay_together(make_docs):
    rows = sharding.shard_documents(make_docs(["same text"] * 600 + [f"text number {k} " * 4 for k in range(1000)] + ["twin"] * 2), n_shards=8).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r.size
    assert max(held.values()) <= 1.1 * sum(held.values()) / 8
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same text")}) > 1


def test_hot_rows_without_ids_of_their_own_are_split(make_docs):
    for one_id in (None, 7):
        docs = make_docs([(one_id, "same text")] * 600 + [(1000 + k, f"text number {k} " * 4) for k in range(1000)])
        rows = sharding.shard_documents(docs, n_shards=8).collect()
        held, places = defaultdict(int), defaultdict(list)
        for r in rows:
            held[r.shard] += r.size
            places[r.shard].append(r.slot)
        assert len(rows) == 1600 and len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same text")}) > 1
        assert max(held.values()) <= 1.1 * sum(held.values()) / 8
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_odd_rows(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 9
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (0, 1)} == {(16, 0)}
    assert sharding.shard_documents(empty).count() == 0


def test_edited_map_moves_little():
    cells = {(k, 0): 10 + k % 3 for k in range(400)}
    plan = sharding.plan_shards(cells, 10)
    same = sharding.edit_plan(plan, cells, 10)
    assert same == plan
    grown = sharding.edit_plan(plan, cells, 11)
    moved = [c for c in cells if grown[c] != plan[c]]
    assert all(grown[c] == 10 for c in moved) and len(moved) <= 400 / 11 + 5
    shrunk = sharding.edit_plan(plan, cells, 9)
    assert max(shrunk.values()) == 8
    held = [sum(cells[c] for c in cells if shrunk[c] == s) for s in range(9)]
    assert max(held) <= 1.05 * sum(held) / 9


def test_versions_of_a_map(spark, tmp_path):
    store = sharding.SlotMap(spark, f"file://{tmp_path}/map")
    cells = {(0, 0): 5, (1, 0): 7}
    store.write(1, {(0, 0): 0, (1, 0): 1}, cells, {})
    store.write(2, {(0, 0): 1, (1, 0): 1}, cells, {})
    assert [r.shard for r in store.read(1).orderBy("v_slot").collect()] == [0, 1]
    assert [r.shard for r in store.read(2).orderBy("v_slot").collect()] == [1, 1]


def test_groups_that_fit_stay_whole(make_docs):
    """Of texts with a tenth to nine tenths of a share each, none is split, nor is a slot that many texts share."""
    rows = [text for k in range(1, 10) for text in [f"group {k} "] * (10 * k)] + [f"text {k:06d}" for k in range(350)]
    for slots in (4096, 3):
        placed = sharding.shard_documents(make_docs(rows), n_shards=8, slots=slots).collect()
        where, held = defaultdict(set), defaultdict(int)
        for r in placed:
            where[r.text_crc32].add(r.shard)
            held[r.shard] += r.size
        assert max(map(len, where.values())) == 1
        assert max(held.values()) <= 1.15 * sum(held.values()) / 8


def test_next_version_of_the_map(spark, tmp_path):
    docs, path = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), f"file://{tmp_path}/map"
    rows = sharding.shard_documents(docs, n_shards=10, path=path, next_shards=11).collect()
    store = sharding.SlotMap(spark, path)
    maps = [{(r.v_slot, r.sub): (r.shard, r.bytes) for r in store.read(v).collect()} for v in (1, 2)]
    assert all(maps[0][r.virtual_slot, r.sub][0] == r.shard and maps[1][r.virtual_slot, r.sub][0] == r.next_shard for r in rows)
    assert sum(r.size for r in rows if r.next_shard != r.shard) <= 1.5 * sum(r.size for r in rows) / 11
    held = defaultdict(int)
    for r in rows:
        held[r.next_shard] += r.size
    assert max(held.values()) <= 1.1 * sum(held.values()) / 11
    cells = {c: b for c, (_, b) in maps[0].items()}
    assert {c: s for c, (s, _) in maps[1].items()} == sharding.edit_plan({c: s for c, (s, _) in maps[0].items()}, cells, 11)


def test_places_of_chunks(spark, make_docs):
    """Cells that are counted in several chunks have no gap."""
    rows = make_docs([(k % 7, f"text {k % 3}") for k in range(500)]).selectExpr("doc_id", "1L as size", "crc32(text) as text_crc32", "doc_id as number", "cast(crc32(text) % 3 as int) as v_slot", "0 as sub", "0 as shard", "0L as first", "cast(null as int) as next_shard")
    counts = {(r.v_slot, 0): r["count"] for r in rows.groupBy("v_slot").count().collect()}
    got = sharding._numbered(rows, counts, rows=10).collect()
    for (slot, _), n in counts.items():
        assert sorted(r.slot for r in got if r.virtual_slot == slot) == list(range(n))


def spark_hash(data: bytes, seed: int = 42) -> int:
    """Spark's xxhash64, signed."""
    h = xxhash.xxh64_intdigest(data, seed % 2**64)
    return h - 2**64 if h >= 2**63 else h


def emptiest(held: list[int]) -> int:
    return held.index(min(held))


def plain_shards(docs: list[tuple], n_shards: int, slots: int, next_shards: int) -> list[tuple]:
    """(doc_id, size, crc32, virtual slot, sub, shard, place, next shard) by one pass after another over lists; no text may hold more than a share."""
    rows = []
    for doc_id, text in docs:
        raw = (text or "").encode()
        rows.append((doc_id, len(raw) + 16, zlib.crc32(raw), spark_hash(raw)))
    limit = max(1, sum(r[1] for r in rows) // (n_shards * 4))
    by_slot, by_text = Counter(), Counter()
    for _, size, _, h in rows:
        by_slot[h % slots] += size
        by_text[h] += size
    assert max(by_text.values()) <= sum(by_slot.values()) / n_shards
    alone, spread = {}, {}
    for slot, size in by_slot.items():
        large = sorted(h for h in by_text if h % slots == slot and by_text[h] > limit)
        spread[slot] = max(1, math.ceil((size - sum(by_text[h] for h in large)) / limit))
        alone |= {h: spread[slot] + k for k, h in enumerate(large)}

    def cell(h: int) -> tuple[int, int]:
        mixed = spark_hash((17).to_bytes(4, "little"), spark_hash(h.to_bytes(8, "little", signed=True)))
        return h % slots, alone.get(h, mixed % spread[h % slots])

    sizes, members = Counter(), defaultdict(list)
    for r in rows:
        sizes[cell(r[3])] += r[1]
        members[cell(r[3])].append(r)
    shard, held = {}, [0] * n_shards
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        shard[c] = emptiest(held)
        held[shard[c]] += sizes[c]
    most, later, moving = sum(held) / next_shards * 1.02, {}, []
    held = [*held, *[0] * (next_shards - n_shards)]
    for c in sorted(sizes, key=lambda c: (sizes[c], c)):
        if held[shard[c]] > most:
            held[shard[c]] -= sizes[c]
            moving.append(c)
        else:
            later[c] = shard[c]
    for c in sorted(moving, key=lambda c: (-sizes[c], c)):
        later[c] = emptiest(held)
        held[later[c]] += sizes[c]
    out, places = [], Counter()
    for c in sorted(members):
        for doc_id, size, crc, _ in sorted(members[c], key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
            out.append((doc_id, size, crc, *c, shard[c], places[shard[c]], later[c]))
            places[shard[c]] += 1
    return out


def test_against_plain_lists(spark, make_docs):
    """Whole tables, a group of copies near a share, null and empty texts, repeated rows, and slots that many texts share."""
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    total = sum(len((t or "").encode()) for _, t in table)
    copies = [(10**6 + k, "a copied text " * 100) for k in range(total // 1400 // 9)]
    odd = [(None, None), (None, ""), (5, "x"), (5, "x"), (None, "no id"), (-3, "اسم 😀")]
    for rows, slots in ((table, 4096), (table + copies + odd, 4096), (table + odd, 5)):
        got = sharding.shard_documents(make_docs(rows), n_shards=8, slots=slots, next_shards=9)
        got = [(r.doc_id, r.size, r.text_crc32, r.virtual_slot, r.sub, r.shard, r.slot, r.next_shard) for r in got.collect()]
        assert Counter(got) == Counter(plain_shards(rows, 8, slots, 9))
