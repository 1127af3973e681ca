import hashlib
import zlib
from collections import defaultdict

import pytest
from frames import awkward, documents, empty, frame, lower, words
from pyspark.sql import functions as F

from siltstone.llm.exact_dedup import drop_exact_copies, exact_groups
from siltstone.llm.mixing import BLOCK_WORDS, GOLDEN, mix, mixed_documents, mixed_sizes, point
from siltstone.llm.sharding import affected_shards, equal_capacities, min_cost_flow, old_layout, reshard, rewrite


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    got = exact_groups(frame(spark), keep=keep).collect()
    groups = defaultdict(list)
    for r in awkward():
        groups[hashlib.sha256(lower(r[1]).encode()).hexdigest()].append(r[0])
    assert len(got) == len(awkward())
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((min if keep == "min" else max)(known) if known else None)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(groups)


def test_drop_exact_copies_keeps_rows_whole(spark):
    df = frame(spark)
    out = drop_exact_copies(df, keep="max")
    assert out.columns == df.columns
    assert len(out.collect()) == len({lower(r[1]) for r in awkward()})
    assert drop_exact_copies(empty(spark)).count() == 0 and exact_groups(empty(spark)).count() == 0


def _targets(sizes, weights=(5, 2, 1), passes=3):
    """Round by round: sources above their limit stop there, the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > passes * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        capped |= {s: passes * sizes[s] for s in over}


@pytest.mark.parametrize("lengths", [[40, 4000, 300], [5, 5, 2000, 1, 700], [0, 10, 3], [1, 30000]])
def test_targets_with_limits(spark, lengths):
    rows = [(i, "w " * n, "en", f"s{i}", 0, 1, 2, "a", 3, "r", 4) for i, n in enumerate(lengths)]
    rows += [(100 + i, "u " * 50, "en", "s1", 0, 1, 2, "a", 3, "r", 4) for i in range(30)]
    got = mixed_sizes(frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken, source = _targets(sizes), defaultdict(int), {r[0]: r[3] for r in rows}
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * BLOCK_WORDS  # a source gives whole blocks, one for each of its slots


def test_the_schedule_decides_what_a_source_gives(spark):
    rows = [(i, "w " * 900, "en", f"s{i % 3}", 0, 1, 2, "a", 3, "r", 4) for i in range(40)]
    taken = {}
    for step in (GOLDEN, 0.123456, 0.5):
        got = mixed_sizes(frame(spark, rows), step=step).collect()
        taken[step] = tuple(sum(r.taken for r in got if r.doc_id % 3 == i) for i in range(3))
    assert len(set(taken.values())) == 3
    target = {r.doc_id % 3: r.target for r in got}
    assert all(abs(taken[GOLDEN][i] - target[i]) <= 3 * BLOCK_WORDS for i in range(3))
    assert max(abs(taken[0.5][i] - target[i]) for i in range(3)) > 10 * BLOCK_WORDS  # two points only: no even schedule


def test_points_of_late_slots_are_exact(spark):
    from fractions import Fraction

    numbers = [1, 2, 1 << 20, (1 << 33) + 12345, (1 << 36) + 7]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    got = [r[0] for r in df.select(point(F.col("n"), GOLDEN)).collect()]
    assert got == pytest.approx([float(Fraction(GOLDEN) * n % 1) for n in numbers], abs=1e-9)


def test_mix_of_awkward_rows(spark):
    got = mixed_sizes(frame(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in awkward())
    again = mixed_sizes(frame(spark).repartition(2)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixed_sizes(empty(spark)).count() == 0


def test_segments_are_the_mix(spark):
    _, segments = mix(documents(spark, ["w " * (50 + i) for i in range(90)]), block_words=64)
    rows = segments.orderBy("slot", "start").collect()
    assert all(r.length > 0 for r in rows)
    share = defaultdict(int)
    for r in rows[: len(rows) // 2]:
        share[r.source] += r.length
    total = sum(share.values())
    for s, w in (("s0", 5), ("s1", 2), ("s2", 1)):
        assert share[s] / total == pytest.approx(w / 8, abs=0.06)  # any prefix of the schedule is near the weights


def test_mixed_documents_stand_in_slot_order(spark):
    df = documents(spark, ["w " * (i % 60) for i in range(120)])
    for rows in (df, df.union(df.filter("doc_id % 7 = 0"))):  # ids once, and some twice
        _, segments = mix(rows, block_words=64)
        slots = defaultdict(list)
        for x in segments.filter("start = 0").orderBy("slot").collect():
            slots[x.doc_id].append(x.slot)
        out = [x.doc_id for x in mixed_documents(rows, block_words=64).collect()]
        size = {x.doc_id: x.size for x in mixed_sizes(rows, block_words=64).collect()}
        full = [d for d in out if size[d]]
        assert sorted(full) == sorted(d for d, at in slots.items() for _ in at) and len(set(full)) < len(full)
        assert {d for d, n in size.items() if not n} >= set(out) - set(full) != set()
        place = [slots[d].pop(0) for d in full]
        assert place == sorted(place)


def test_mixed_documents(spark):
    df = documents(spark, [f"t{i} " * 100 for i in range(60)])
    out = mixed_documents(df)
    assert out.columns == df.columns
    taken = {r.doc_id: r.taken for r in mixed_sizes(df).collect()}
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) == -(-t // 100) for i, t in taken.items())
    assert mixed_documents(empty(spark)).count() == 0
    assert mixed_documents(frame(spark)).count() > 0


def test_mixed_documents_of_repeated_ids_agree_on_reruns(spark):
    rows = [(i // 4, f"v{i % 4} " * 30, "en", f"s{i // 4 % 3}", 90) for i in range(80)]  # ids with four texts of one size
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first, again = ([(r.doc_id, r.text) for r in mixed_documents(x, block_words=64).collect()] for x in (df.repartition(3, "text"), df.orderBy(F.desc("text"))))
    assert first == again and len(first) > 40


def test_min_cost_flow_is_least():
    supply, demand = [70, 20, 10], [25, 25, 25, 25]
    flows = min_cost_flow(supply, demand, lambda i, j: 0 if i == j else 1)
    assert sum(flows.values()) == 100
    assert all(sum(v for (i, _), v in flows.items() if i == k) == s for k, s in enumerate(supply))
    assert sum(v for (i, j), v in flows.items() if i != j) == 45
    price = [[3, 1, 2], [1, 5, 1]]
    best = min_cost_flow([2, 2], [1, 2, 1], lambda i, j: price[i][j])
    assert sum(price[i][j] * v for (i, j), v in best.items()) == 4


def test_reshard(spark):
    df = documents(spark, ["w" * (10 + (i * 37) % 400) for i in range(400)])
    placed = reshard(df, old_layout("doc_id", 4), 6)
    rows = placed.collect()
    bytes_of, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        bytes_of[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 800 and len(bytes_of) == 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    old = defaultdict(int)
    for r in rows:
        old[r.old_shard] += r["size"]
    room = equal_capacities(sum(old.values()), 6)
    least = sum(max(0, s - room[i]) for i, s in old.items())
    assert sum(r["size"] for r in rows if r.shard != r.old_shard) <= least + 6 * 420


def test_reshard_awkward_and_rewrite(spark, tmp_path):
    rows = {(r.doc_id, r.text_crc32, r["size"]) for r in reshard(frame(spark), old_layout("doc_id", 3), 4).collect()}
    assert rows == {(r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8) for r in awkward()}
    assert reshard(empty(spark), old_layout("doc_id", 3), 4).count() == 0
    df = documents(spark, [f"t{i}" for i in range(50)])
    df.withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(str(tmp_path / "out"))
    placed = reshard(df, F.lit(0), 3)
    assert rewrite(df, placed, str(tmp_path / "out")) == affected_shards(placed) == [0, 1, 2]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}
