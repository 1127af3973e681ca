import hashlib
import random

import pytest
from frames import awkward, documents, empty, frame, lower, near_texts, prose, words

from siltstone.llm.components import components
from siltstone.llm.near import drop_near_copies, near_groups
from siltstone.llm.substrings import drop_repeats


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_near_groups(spark, orders):
    texts = near_texts(seed=orders)
    got = {r.doc_id: r.component_id for r in near_groups(documents(spark, texts), orders=orders).collect()}
    want = brute_near(list(enumerate(texts)))
    assert got == want and 1 < len(set(want.values())) < len(texts)


def test_near_groups_of_awkward_rows(spark):
    got = near_groups(frame(spark)).collect()
    want = brute_near([(r[0], r[1]) for r in awkward()])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted((r[0] is None, r[0] or 0, len(shingles(r[1]))) for r in awkward())
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert near_groups(empty(spark)).count() == 0


def test_more_star_rounds_change_nothing(spark):
    texts = near_texts(seed=9, groups=3, copies=12, words_each=60)
    want = brute_near(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in near_groups(documents(spark, texts), rounds=3).collect()} == want


def test_rows_of_one_id_with_different_texts_link_through_it(spark):
    a, b, c = (prose(random.Random(i), 100, 9000) for i in range(3))
    rows = [(5, a), (5, b), (3, a + " end"), (9, b + " end"), (7, c), (None, c), (8, c.upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = near_groups(df).collect()
    want = brute_near(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted((i is None, i or 0, len(shingles(t))) for i, t in rows)
    assert {r.doc_id: r.component_id for r in got} == want | {None: None} and want[9] == 3
    with pytest.raises(TypeError):
        near_groups(df.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_unbounded_postings_and_texts_beyond_a_block(spark):
    """Every token known as frequent goes as rows; texts of more than 1 MB link as others do."""
    texts = near_texts(seed=2, groups=3, copies=8)
    got = {r.doc_id: r.component_id for r in near_groups(documents(spark, texts), hot_finds=1).collect()}
    assert got == brute_near(list(enumerate(texts)))
    long = prose(random.Random(6), 300_000, 50_000)
    assert len(long) > 1 << 20
    got = {r.doc_id: r.component_id for r in near_groups(documents(spark, [long, long + " tail", "one " + long, long[::-1]])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_drop_near_copies(spark):
    texts = near_texts(seed=4)
    df = documents(spark, texts)
    out = drop_near_copies(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == set(brute_near(list(enumerate(texts))).values())
    assert sum(r.doc_id is None for r in drop_near_copies(frame(spark)).collect()) == 2


def test_components(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    loose = [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)]
    links = chain + loose + [(7, None), (3, 3)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
    parent = {}
    for a, b in chain + loose:
        for x in (a, b):
            parent.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in chain + loose:
            low = min(parent[a], parent[b])
            if parent[a] != low or parent[b] != low:
                parent[a] = parent[b] = low
                changed = True
    linked = {x for a, b in chain + loose if a != b for x in (a, b)}
    assert got == {x: c for x, c in parent.items() if x in linked}


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, dead = words(t), set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                dead.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in dead]
        out.append((i, len(w), len(dead), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, *x[1:])


@pytest.mark.parametrize("length,seed", [(50, 20), (8, 3), (8, 8)])
def test_repeats(spark, length, seed):
    r = random.Random(length)
    passages = [prose(r, n, 300) for n in (30, 55, 80, 200)]
    texts = []
    for _ in range(30):
        parts = [prose(r, r.randrange(0, 60), 300)] + [x for _ in range(3) for x in (r.choice(passages), prose(r, r.randrange(0, 30), 300))]
        texts.append(" ".join(parts))
    texts += [passages[3], passages[3] + " " + passages[3], texts[0], "be " * 200, "be " * 90]
    got = drop_repeats(documents(spark, texts), length=length, seed=seed).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == sorted(brute_repeats(list(enumerate(texts)), length))
    for x in got:
        assert sum(s.length for s in x.removed_spans) == x.n_removed


def test_repeats_of_awkward_rows(spark):
    got = drop_repeats(frame(spark)).collect()
    want = brute_repeats([(r[0], r[1]) for r in awkward()], 50)
    assert sorted(map(key, [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got])) == sorted(map(key, want))
    assert drop_repeats(empty(spark)).count() == 0
