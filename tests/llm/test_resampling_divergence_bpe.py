import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from frames import awkward, empty, frame, lower, near_texts, prose

from siltstone.llm import bpe
from siltstone.llm.bpe import encode_decode, joined
from siltstone.llm.divergence import RadixTrie, TermCounts, divergence
from siltstone.llm.resampling import crc32_spans, resample

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ importance resampling


def features(text, max_run):
    w = RUN.findall(lower(text))
    return w, [" ".join(w[i : i + n]) for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent, min_words, seed, max_run, buckets):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    made = [features(t, max_run) for _, t in docs]
    s = Counter(of(f) for _, fs in made for f in fs)
    t = Counter(of(f) for x in target for f in features(x, max_run)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for (i, _), (w, fs) in zip(docs, made):
        weight = sum(gain[of(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("max_run,buckets,percent", [(1, 10_000, 10), (2, 97, 40), (3, 1, 100)])
def test_resample_against_brute_force(spark, max_run, buckets, percent):
    docs = awkward() + [(100 + i, t, "en", "s1", 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(near_texts())]
    target = [prose(random.Random(5), 80, 300), None, "", "ONE day, of w3-w4 and é"]
    got = resample(frame(spark, docs), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id int, text string"), percent, 20, 2024, max_run, buckets)
    want = resampled([(d[0], d[1]) for d in docs], [x or "" for x in target], percent, 20, 2024, max_run, buckets)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    rows = [tuple(r) for r in got.collect()]
    # rows that are alike share their ranks in any order
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resample_of_nothing(spark):
    target = spark.createDataFrame([], "item_id int, text string")
    assert resample(empty(spark), target).count() == 0
    alone = resample(frame(spark), target).collect()
    assert len(alone) == len(awkward()) and all(r.weight == 0 for r in alone if r.n_features == 0)


def test_a_word_in_every_text_is_spread_over_tasks(spark):
    docs = [(i, "common " * 30 + f"w{i}", "en", "s", 0, 1, 2, "a", 3, "r", 4) for i in range(400)]
    got = resample(frame(spark, docs), spark.createDataFrame([(1, "common w3")], "item_id int, text string"), 25)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 101))


def test_crc_of_spans():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(5000))
    starts = np.array([r.randrange(4000) for _ in range(300)])
    ends = starts + np.array([r.choice([0, 1, 5, 20, 48, 49, 700]) for _ in range(300)])
    assert crc32_spans(np.frombuffer(data, np.uint8), starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]


# ------------------------------------------------------------------ source divergence


def diverged(docs, min_docs, top):
    count, frequency, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(lower(text))
        count[lang, source].update(found)
        frequency.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in frequency.items() if x == lang and n >= min_docs)
        sources = [s for x, s in groups if x == lang]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + math.floor(Fraction(10**9 * (counts[t] + 2), n + 2 * v)) for t in kept}

        f = lambda p, q: math.floor(Fraction((p - q) ** 2, p + q))
        share = {s: shares(count[lang, s]) for s in sources}
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(share[s][t], whole[t])) for t in kept if count[lang, s][t] and share[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:most])]
    return out


@pytest.mark.parametrize("min_docs,top", [(1, 3), (3, 10), (10_000, 10)])
def test_divergence_against_brute_force(spark, min_docs, top):
    r = random.Random(4)
    docs = [(i, d[1], r.choice(["en", "de", None, "en"]), d[3]) + d[4:] for i, d in enumerate(awkward() * 3)]
    docs += [(900 + i, " ".join(f"{r.choice('abcz')}{r.choice(['é', 'b', 'ß', ''])}{r.choice('xyé')}" for _ in range(50)), "fr", f"s{i % 5}") + docs[0][4:] for i in range(40)]
    got = divergence(frame(spark, docs), min_docs, top)
    assert sorted(tuple(x) for x in got.collect()) == sorted(diverged([(d[1], d[2], d[3]) for d in docs], min_docs, top))


def test_divergence_of_nothing_and_of_one_source(spark):
    assert divergence(empty(spark)).count() == 0
    one = [(i, "same words here", "en", "s", 0, 1, 2, "a", 3, "r", 4) for i in range(12)]
    assert divergence(frame(spark, one)).count() == 0


def test_tries_merge_and_traverse_in_byte_order():
    r = random.Random(9)
    terms = [bytes(r.choice(b"ab\xc3\xff") for _ in range(r.randrange(1, 9))) for _ in range(2000)]
    one, other, both = RadixTrie(), RadixTrie(), Counter(terms)
    for i, t in enumerate(terms):
        (one if i % 3 else other).add(t, 1, {"s": 1})
    one.merge(other)
    walked = [(t, leaf[1]["s"]) for t, leaf in one.traverse()]
    assert all(leaf[0] == leaf[1]["s"] for _, leaf in one.traverse())
    assert walked == sorted(both.items())
    assert one.leaves == len(both)


def test_counts_of_a_text_in_slices(monkeypatch):
    monkeypatch.setattr("siltstone.llm.divergence.SLICE", 7)
    text = "Alpha beta-gammadelta éé alpha BETA longlonglonglonglong x"
    counts = TermCounts()
    counts.count("en", "s", text.encode())
    counts.settle()
    assert {t.decode(): (leaf[1]["s"], leaf[0]) for t, leaf in counts.tries["en"].traverse() if t} == {t: (n, 1) for t, n in Counter(TERM.findall(lower(text))).items()}


# ------------------------------------------------------------------ BPE


def texts():
    r = random.Random(11)
    odd = ["It's  naïve café é ́x Å ﬁ İ ΑΣ σς <|endoftext|> <|startoftext|>!!", "日本語 の テキスト 😀👍🏽 don't we'll", "tab\tand\r\nlines\n\n\x85 end ", " lead", "x" * 3000, "á " * 300]
    long = [" ".join(r.choice(odd[0].split() + odd[1].split() + ["word", "Other,", "(42)", "1999"]) for _ in range(n)) for n in (31, 64, 500, 3000)]
    return odd + long + ["be " * 4000] + near_texts(groups=3, words_each=400)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_bpe_equals_the_tokenizer_on_whole_texts(spark, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    docs = awkward() + [(100 + i, t, "en", "s1", 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(texts())]
    rows = encode_decode(frame(spark, docs), path, keep=True).collect()

    def want(i, text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        raw, back = np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)
        return (i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), raw, back)

    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids), r.decoded) for r in rows]
    assert sorted(got, key=key) == sorted((want(d[0], d[1]) for d in docs), key=key)


def test_bpe_of_nothing(spark):
    assert encode_decode(empty(spark), WORD_BPE).count() == 0


def test_cuts_follow_the_content():
    base = prose(random.Random(3), 3000, 5000)
    of = lambda text: {text.encode()[s:e] for s, e, _, _ in bpe.cuts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]}
    a, b = of(base), of("another beginning of some words " + base)
    assert len(a) > 10 and len(a & b) >= len(a) - 3
    assert max(len(x.split()) for x in of("be " * 9000)) <= bpe.MOST


def test_joins_are_mended_until_they_agree():
    # a tokenizer of pairs of letters inside words, which also ties a word's last letter to the white space behind it
    def encode(text):
        return b"".join(bytes([len(x)]) + x.encode() for x in re.findall(r"[a-z] (?=[a-z])|[a-z]{2}|.", text))

    text = "aaa bbb cccc dd eee"
    for at in (7, 12):
        left, right = text[:at], text[at:]
        tail, head = re.search(r"(^| )\S+ \S+$", left)[0], re.match(r" \S+( \S+)?", right)[0]
        got = joined([encode(left), encode(right)], [tail.encode()], [head.encode()], encode, 1)
        assert got is None or got == encode(text)
    assert joined([b"x", b"y"], [b"zz"], [b"y"], lambda x: x.encode(), 1) is None


def test_texts_whose_joins_cannot_be_mended_are_encoded_whole(spark, monkeypatch):
    monkeypatch.setattr("siltstone.llm.bpe.joined", lambda *a: None)
    docs = [(i, t, "en", "s", 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(["one two", "one two", None, "three " * 90])]
    from siltstone.llm import packing

    encode = packing.CachedWordBpe(WORD_BPE).encode
    want = sorted((i, len(encode(d[1] or "")) // 2) for i, d in enumerate(docs))
    assert sorted((r.doc_id, r.n_tokens) for r in encode_decode(frame(spark, docs), WORD_BPE).collect()) == want


def test_a_hot_chunk_is_dealt_to_many_groups(spark):
    passage = prose(random.Random(8), 900, 4000)
    docs = [(i, prose(random.Random(i), 60, 4000) + " " + passage, "en", "s", 0, 1, 2, "a", 3, "r", 4) for i in range(150)]
    rows = encode_decode(frame(spark, docs), WORD_BPE, keep=True).collect()
    from siltstone.llm.packing import CachedWordBpe

    encode = CachedWordBpe(WORD_BPE).encode
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {d[0]: np.frombuffer(encode(d[1]), "<u2").tolist() for d in docs}
