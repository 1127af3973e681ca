"""Texts beyond every block and chunk of the operators (1 MB and 4 MB), against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from frames import documents, lower, prose, words
from test_near_substrings import brute_repeats
from test_packing_quality_pages import brute_quality
from tokenizers import Tokenizer

from siltstone.llm.exact_dedup import drop_exact_copies, exact_groups
from siltstone.llm.mixing import mixed_sizes
from siltstone.llm.packing import pack
from siltstone.llm.quality import quality
from siltstone.llm.sharding import old_layout, reshard
from siltstone.llm.substrings import drop_repeats
from siltstone.llm.templates import extract
from siltstone.llm.toxicity import score, train


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    long = "\n".join(prose(r, 20, 30_000) for _ in range(36_000))
    assert len(long) > 4 << 20
    tail = " ".join(words(long)[-400:])
    return ["short one", long, tail + " " + prose(r, 30), long[: 1 << 20] + " é", long.upper(), "", None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts)


def test_exact(docs, texts):
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(lower(t), []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, keep="max").collect()}
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by_text.items() for i in g}
    assert sorted(r.doc_id for r in drop_exact_copies(docs, keep="max").select("doc_id").collect()) == sorted(max(g) for g in by_text.values())


def test_substrings(spark, docs, texts):
    got = {(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in drop_repeats(docs).collect()}
    assert got == set(brute_repeats(list(enumerate(texts)), 50))
    assert next(x for x in got if x[0] == 2)[2] >= 400 - 1


def test_quality(docs, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality(docs).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_packing(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ids = Tokenizer.from_file(path), {}
    for p in sorted(pack(docs, path).collect(), key=lambda p: p.start):
        assert p.length <= 4096 and len(ids.get(p.doc_id, [])) == p.start
        ids.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert ids == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_sizes_of_mix_and_shards(docs, texts):
    sizes = {r.doc_id: r["size"] for r in mixed_sizes(docs).collect()}
    assert sizes == {i: len(words(t)) for i, t in enumerate(texts)}
    rows = {(r.doc_id, r["size"], r.text_crc32) for r in reshard(docs, old_layout("doc_id", 3), 4).collect()}
    assert rows == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}


def test_toxicity_looks_at_the_end_of_a_text(spark, texts):
    r = random.Random(6)
    bad = [f"vile{c}word" for c in "abcdefgh"]
    ordinary = [prose(r, 60) for _ in range(200)]
    toxic = [" ".join(r.choice(bad) if r.random() < 0.3 else w for w in prose(r, 60).split()) for _ in range(200)]
    model = train(toxic, ordinary)
    long = "\n".join(prose(r, 20) for _ in range(60_000))
    assert len(long) > 4 << 20
    got = {x.doc_id: x["_sl_score"] for x in score(documents(spark, [long, long + " " + " ".join(bad * 200_000), ""]), model).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and got[1] > max(got[0], got[2])


def test_pages(spark):
    r = random.Random(7)
    blocks = [prose(r, 40) for _ in range(25_000)]
    html = "<html><body><nav><a>Home</a></nav><article>" + "".join(f"<p>{b}</p>\n" for b in blocks) + "</article><footer>Foot</footer></body></html>"
    assert len(html) > 4 << 20
    got = extract(spark.createDataFrame([(1, "http://l.example/1", html)], "page_id bigint, url string, html string")).collect()
    assert got[0].text == "\n".join(blocks) and got[0].n_chars == len(got[0].text)
