"""Shards of repeated rows, and against a plain largest-first placement."""

import hashlib
import heapq

from refracta.llm import sharding

SHARDS = 24


def load_of(rows):
    load = [0] * SHARDS
    for r in rows:
        load[r["shard"]] += r["size"]
    return load


def plain_shards(docs, slots=sharding.SLOTS):
    """Slot and shard of every row, with repeated rows numbered as they come."""
    seen, slot_of, sizes = {}, [], {}
    for doc_id, text in docs:
        key = hashlib.md5(f"{'' if doc_id is None else doc_id}|{text or ''}".encode()).hexdigest()
        seen[key] = seen.get(key, -1) + 1
        slot = int(hashlib.md5(f"{key}|{seen[key]}".encode()).hexdigest()[:15], 16) % slots
        slot_of.append(slot)
        sizes[slot] = sizes.get(slot, 0) + len((text or "").encode()) + 8
    heap, shard_of = [(0, k) for k in range(SHARDS)], {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return sorted((doc_id is None, doc_id or 0, len((text or "").encode()) + 8, s, shard_of[s]) for (doc_id, text), s in zip(docs, slot_of))


def test_shards_match_a_plain_placement(spark):
    docs = [(i % 90 or None, "wörd " * (i * i % 37) if i % 11 else None) for i in range(400)] + [(5, "twice")] * 7
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    rows = [(r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["virtual_slot"], r["shard"]) for r in got]
    assert sorted(rows) == plain_shards(docs)


def test_repeated_rows_are_spread_evenly(spark):
    docs = [(None, "one text that half of all the rows repeat " * 3)] * 6000
    docs += [(i, f"text {i} " * (i % 30)) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sharding.shard(df).collect()
    load = load_of(got)
    assert len(got) == len(docs)
    assert max(load) <= 1.05 * sum(load) / SHARDS and min(load) >= 0.95 * sum(load) / SHARDS
    copies = [0] * SHARDS
    places = {}
    for r in got:
        copies[r["shard"]] += r["doc_id"] is None
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(copies) <= 1.3 * 6000 / SHARDS
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # another layout of the same rows gives the same shards

    def count(rows):
        out = {}
        for r in rows:
            key = (r["doc_id"], r["size"], r["shard"], r["virtual_slot"])
            out[key] = out.get(key, 0) + 1
        return out

    assert count(sharding.shard(df.repartition(3)).collect()) == count(got)


def test_a_row_keeps_its_slot_when_others_come(spark):
    docs = [(i, f"t{i % 5}") for i in range(50)]
    few = sharding.slotted(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    more = sharding.slotted(spark.createDataFrame(docs + [(99, "t1")] * 3, "doc_id long, text string")).collect()
    slots = {r["doc_id"]: r["virtual_slot"] for r in more if r["doc_id"] != 99}
    assert {r["doc_id"]: r["virtual_slot"] for r in few} == slots
