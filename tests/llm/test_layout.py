"""Sharding and mixing against plain versions."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlake.llm.mixing import block_slots, measured, mix_sources, release, whole_shares
from reviewlake.llm.sharding import Cells, minimax_shards, shard_documents


def greedy(sizes, shards, capacity):
    """Shard starts of a greedy cut, or None if it needs too many shards."""
    starts, held = [0], 0
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if held + s > capacity:
            starts.append(i)
            held = 0
        held += s
    return starts if len(starts) <= shards else None


def plain_shards(groups, shards):
    """Shard by hash: large groups first, the rest cut at the smallest capacity, tried one by one."""
    left, large = sum(groups.values()), []
    for h, s in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if len(large) + 1 >= shards or s * (shards - len(large)) <= left:
            break
        large.append(h)
        left -= s
    rest = sorted(h for h in groups if h not in large)
    sizes = [groups[h] for h in rest]
    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, shards - len(large), mid) else (mid + 1, high)
    starts = greedy(sizes, shards - len(large), low)
    out = {h: i for i, h in enumerate(large)}
    return out | {h: len(large) + sum(s <= i for s in starts) - 1 for i, h in enumerate(rest)}


@pytest.mark.parametrize(("shards", "at_once"), [(7, 4), (40, 16), (3, 1 << 12)])
def test_shards_equal_a_plain_search(spark, shards, at_once):
    rows = spark.range(700).select(
        F.xxhash64(F.col("id") % 500).alias("h"),
        (F.pmod(F.xxhash64("id"), F.lit(97)) + F.when(F.col("id") % 500 == 3, 4000).otherwise(0)).cast("long").alias("size"))
    got = minimax_shards(rows, "size", "h", shards, at_once=at_once).collect()
    groups = Counter()
    for r in got:
        groups[r.h] += r.size
    assert {r.h: r["shard"] for r in got} == plain_shards(groups, shards)


def test_shards_of_documents(documents):
    rows = shard_documents(documents, 10).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "bytes")
        by_text[raw].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_documents(odd_documents, no_documents):
    rows = shard_documents(odd_documents, 4).collect()
    assert len(rows) == odd_documents.count() and {r.shard for r in rows} <= set(range(4))
    nothing = next(r for r in rows if r.doc_id == 2)
    assert (nothing.size, nothing.text_crc32) == (16, 0)
    assert len({r.shard for r in rows if r.size in (16,)}) == 1         # null and empty texts
    assert shard_documents(no_documents, 4).collect() == []


def test_cells_without_groups():
    assert Cells([]).doubtful(3) == [] and Cells([]).cuts(0, 3, None) == [0, 0, 0]


def plain_schedule(shares, blocks, period):
    """Slot by slot: of the blocks that may start the one with the earliest deadline, then by name; (source, block, slot)."""
    out, done, slot = [], {s: 0 for s in shares}, 0
    while any(done[s] < blocks[s] for s in shares):
        ready = [(-(-(done[s] + 1) * period // a), str(s), s) for s, a in shares.items()
                 if done[s] < blocks[s] and done[s] * period // a <= slot]
        if ready:
            s = min(ready)[2]
            out.append((s, done[s], slot))
            done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {i: i + 1 for i in range(30)}])
def test_slots_equal_a_plain_schedule_and_keep_within_a_block(weights):
    period = 997
    shares = whole_shares(weights, period)
    assert sum(shares.values()) == period and min(shares.values()) >= 1
    for blocks in (dict(shares), {s: 1 + 7 * i % 40 for i, s in enumerate(shares)}):
        assert list(block_slots(shares, blocks, period)) == plain_schedule(shares, blocks, period)
    placed, done = list(block_slots(shares, dict(shares), period)), Counter()
    assert [s for _, _, s in placed] == list(range(period))
    for source, j, slot in placed:
        assert j == done[source] and release(j, shares[source], period) <= slot < -(-(j + 1) * period // shares[source])
        done[source] += 1
        for s, a in shares.items():
            assert abs(done[s] - (slot + 1) * a / period) < 1


def test_mixture_equals_a_plain_schedule(documents):
    """Every block of the given documents lies in the slot that the plain schedule gives it."""
    weights, period, block = {"src0": 3.0, "src1": 1.0}, 100, 4096
    rows = mix_sources(documents, weights, period=period, block=block).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode()) + 16
    shares = whole_shares({s: weights.get(s, 1.0) for s in sizes}, period)
    # A block more for each source marks where it has run out.
    plain = plain_schedule(shares, {s: -(-n // block) + 1 for s, n in sizes.items()}, period)
    slots = {(s, j): slot for s, j, slot in plain}
    assert all(r.slot == slots[r.source, r.block] for r in rows)


def test_too_many_sources():
    with pytest.raises(ValueError):
        whole_shares({i: 1 for i in range(11)}, 10)


def test_mixture_places_every_document_once(documents):
    rows = mix_sources(documents, {"src0": 3.0, "src1": 1.0}, period=100, block=4096).collect()
    assert len(rows) == documents.count()
    used = {(r.source, r.block): r.slot for r in rows}
    assert len(set(used.values())) == len(used)                  # a slot holds one block
    assert all(r.release <= r.slot < r.deadline for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for own in by_source.values():
        at = 0
        for r in sorted(own, key=lambda r: r.place):
            assert r.place == at and r.block == at // 4096
            at += len(r.text.encode()) + 16
    last = max(r.slot for r in rows if r.in_mix)
    ends = {s: max(r.block for r in own) for s, own in by_source.items()}
    assert all(r.slot < last or not r.in_mix or r.slot == last for r in rows) and ends


def test_many_small_sources_keep_the_targets(spark):
    """12,000 sources of one block beside a large one: no limit, true weights, and every prefix within a block of its target."""
    rows = [(i, "large", 300, i * 7919) for i in range(6000)] + [(10_000 + i, f"small{i}", 300, i) for i in range(12_000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, spread long")
    weights = {"large": 0.94, **{f"small{i}": 0.06 / 12_000 for i in range(12_000)}}
    got = mix_sources(table, weights, block=300).collect()
    assert len(got) == len(rows) and len({r.slot for r in got}) == len(rows)
    assert all(abs(r.weight - weights[r.source]) < 1e-11 and r.release <= r.slot < r.deadline for r in got)
    seen = 0
    for n, r in enumerate(sorted((r for r in got if r.in_mix), key=lambda r: r.slot), 1):
        seen += r.source == "large"
        assert abs(seen - 0.94 * n) < 1.001
    assert seen > 5000


def test_mixture_of_odd_documents(odd_documents, no_documents):
    rows = mix_sources(odd_documents, block=64).collect()
    assert len(rows) == odd_documents.count() and all(isinstance(r.block, int) for r in rows)
    assert {r.source for r in rows} == {"a", "b", "c", None}
    narrow = odd_documents.drop("size").select("doc_id", "source", measured()[0].alias("size"), measured()[1].alias("spread"))
    assert mix_sources(narrow, block=64).count() == len(rows)
    assert mix_sources(no_documents).collect() == []
