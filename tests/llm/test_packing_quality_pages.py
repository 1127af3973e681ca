import json
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from comparison import assert_same, duck
from frames import awkward, documents, empty, frame, prose, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm.packing import CachedWordBpe, has_form, pack
from siltstone.llm.quality import COMMON_BYTES, meet_common, quality
from siltstone.llm.queries import op10_sql
from siltstone.llm.templates import Walk, _host, _salts, article_slots, deduce, extract

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cached_ids_equal_the_tokenizer():
    cached, plain = CachedWordBpe(PATH), Tokenizer.from_file(PATH)
    texts = [r[1] or "" for r in awkward()]
    texts += ["don't stop 'S x'REx", "Σίσυφος ΣΑΣ ǅ", "a\x1cb\x85c\xa0d", "日本語 😀👍🏽 <|endoftext|> z", "½²³ª ß ẞ İ ı", "ﬁ ﬂ ö é", "a.b,c.,d ...e,,", "x​y﻿z", "1234 12.5% $5", "\x0bv\x0cf", "µ × ÷ ÿ"]
    for t in texts:
        assert np.frombuffer(cached.encode(t), "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("cached", [True, False])
def test_pack_round_trip(spark, cached):
    plain, pieces = Tokenizer.from_file(PATH), pack(frame(spark), PATH, 64, cached=cached).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32 and p.offset + p.length <= 64
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens, p.sequence_id * 64 + p.offset - p.start), []).append((p.start, ids.tolist()))
    for k, parts in by_sequence.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 64 or k == max(by_sequence)
    got = Counter((doc, tuple(x for _, ids in sorted(parts) for x in ids)) for (doc, _, _), parts in by_doc.items())
    assert got == Counter((r[0], (*plain.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in awkward())
    assert pack(empty(spark), PATH).count() == 0


def test_other_tokenizers_are_not_cached(spark, tmp_path):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert has_form(PATH) and not has_form(other)
    changed = json.loads(open(PATH, encoding="utf-8").read())
    changed["truncation"] = {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}
    limited = tmp_path / "limited.json"
    limited.write_text(json.dumps(changed), encoding="utf-8")
    assert not has_form(str(limited))
    for path, whole in ((other, other), (str(limited), PATH)):
        with pytest.raises(ValueError):
            pack(frame(spark), path, 64, cached=True)
        plain, ids = Tokenizer.from_file(whole), {}
        for p in sorted(pack(documents(spark, ["Don't STOP  now <b> é 12", "", "x" * 300 + " y"]), path, 64).collect(), key=lambda p: p.start):
            ids[p.doc_id] = ids.get(p.doc_id, []) + np.frombuffer(p.ids, "<u4").tolist()
        assert ids == {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(["Don't STOP  now <b> é 12", "", "x" * 300 + " y"])}


def brute_quality(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    dead = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(dead)


def test_quality_figures(spark):
    extra = ["a b\na b\n a b\nc #1 <x>|&%$*\n\nc", "x y z u v " * 9, "one two three four five six seven eight nine ten é\n" * 2]
    rows = awkward() + [(900 + i, t, "en", "s1", 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(extra)]
    got = quality(frame(spark, rows)).collect()
    figure = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted(map(figure, got)) == sorted((r[0] is None, r[0] or 0, *brute_quality(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality(empty(spark)).count() == 0


def test_boilerplate_lines(spark):
    import random

    r = random.Random(2)
    banner = "accept all of our many cookies now"
    texts = [prose(r, 40, 9000) + "\n  " + banner.upper() + " " for _ in range(20)] + [banner + "\n" + prose(r, 3, 9000) for _ in range(10)]
    rows = [(i, t, "en", None, 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "en", None, 0, 1, 2, "a", 3, "r", 4) for i in range(40)]  # copies count once
    got = {x.doc_id: x for x in quality(frame(spark, rows)).collect()}
    assert all(got[i].kept and got[i].n_boilerplate_words == 7 for i in range(20))
    assert not any(got[i].kept for i in range(20, 30)) and all(got[100 + i].kept for i in range(40))


def test_boilerplate_lines_are_removed_from_the_text(spark):
    banner = "Accept all  of our many cookies"
    texts = [f"own {i} first line\n\n {banner.upper()}\t\nown {i} é last  line\n{banner}" for i in range(30)] + ["just this\n", None, ""]
    rows = [(i, t, "en", "s1", 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(texts)] + [(50, texts[0], "en", "s2", 0, 1, 2, "a", 3, "r", 4)]
    got = {x.doc_id: x.text for x in quality(frame(spark, rows)).collect()}
    assert all(got[i] == f"own {i} first line\n\nown {i} é last  line" for i in range(30))
    assert (got[30], got[31], got[32], got[50]) == ("just this\n", None, "", texts[0])


LIMITS = {"line_documents": 2, "line_share": 0.001, "depleted": 0.05}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("broadcast_bytes", [COMMON_BYTES, 0])
def test_boilerplate_agrees_with_sql(spark, broadcast_bytes):
    """At limits where the given documents have boilerplate and depleted ones; common lines broadcast, and dealt by host."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = quality(docs, **LIMITS, broadcast_bytes=broadcast_bytes).drop("text").toPandas()
    assert (got.n_boilerplate_words > 0).any() and (~got.kept & ~got.base_failed).any()
    assert_same(got, duck(op10_sql(**LIMITS), folder))


def test_a_hot_host_goes_to_several_tasks(spark):
    texts = [f"own {i} line\nthe same banner for all" for i in range(90)]
    rows = [(i, t, "en", ["s1", None][i % 30 == 7], 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(texts)] + [(200, "x", "en", "s9", 0, 1, 2, "a", 3, "r", 4), (None, None, None, None, 0, 1, 2, "a", 3, "r", 4)]
    key = lambda df: sorted((r.doc_id or -1, r.text or "", r.n_boilerplate_words) for r in df.collect())
    dealt, plain = quality(frame(spark, rows), broadcast_bytes=0), quality(frame(spark, rows))
    assert key(dealt) == key(plain) and len(key(dealt)) == len(rows)
    slim = spark.createDataFrame([(i, "h", str(i)) for i in range(400)], "_sl_id int, _sl_host string, _sl_text string")
    common = spark.createDataFrame([("h", [b"1"])], "_sl_host string, _sl_common array<binary>")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1")):
            spark.conf.set(k, v)
        salted = meet_common(slim, common, 0).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_sl_common")).alias("met")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in salted) == 400 and all(r.met == 1 for r in salted) and len(salted) > 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script></head><body><div class="cookie-notice"><p>Accept</p></div><nav><ul><li><a href=/a>Menu{0}</a></ul></nav>
<div id="page"><article><h1>Title &amp; {0}</h1><p>First   line<br>of <b>{0}</b> &lt;b&gt; &copy;<p>Second{0}<ul><li>a{0}<li>b{0}</ul><!-- <p>hidden</p> --><form><p>Name</p></form></article><div class="comments"><p>Nice {0}</p></div></div>
<aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_extract(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(12)] + [(50, None, None), (51, "x", ""), (52, "http://b.example", "<p>one<p>two <i>x</i>y</p>tail &am"), (0, "http://a.example/0", PAGE.format(0))]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id bigint, url string, html string, role int, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(df).collect()}
    for i in range(12):
        want = f"Title & {i}\nFirst line of {i} <b> ©\nSecond{i}\na{i}\nb{i}"
        assert got[i] == (want, len(want))
    assert got[50] == got[51] == ("", 0) and got[52][0] == "one\ntwo xy\ntail &am"
    assert extract(df.limit(0)).count() == 0 and extract(df).count() == len(rows)


def test_template_without_marks(spark):
    page = "<html><body><div><p>Subscribe today for more</p></div><div><h2>H{0}</h2><p>Body of page {0} is long enough to count</p></div><div><p>All rights kept</p></div></body></html>"
    rows = [(i, f"http://c.example/{i}", page.format(i)) for i in range(12)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"H{i}\nBody of page {i} is long enough to count" for i in range(12))


def test_short_blocks_beside_the_body_stay(spark):
    page = "<html><body><article><h1>T{0}</h1><div class=body><p>{1}</p></div><p>End {0}</p></article></body></html>"
    long = " ".join(f"word{i}" for i in range(900))
    rows = [(i, f"http://d.example/{i}", page.format(i, f"{i} {long if i else 'short'}")) for i in range(12)] + [(20, "http://alone.example", page.format(20, long))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"T{i}\n{i} {long if i else 'short'}\nEnd {i}" for i in range(12)} | {20: f"T20\n{long}\nEnd 20"}


def test_copies_of_a_page_count_once(spark):
    page = "<html><body><div><h1>Head {0}</h1><p>Body of {0}</p><p>End of {0}</p></div></body></html>"
    rows = [(i, f"http://e.example/?ref={i}", page.format(0)) for i in range(20)] + [(20, "http://e.example/20", page.format(20))]
    rows += [(100 + i, None, page.format(0)) for i in range(12)]
    rows += [(200 + i, f"http://f.example/{i}", page.format(0) + "<!-- %d -->" % i) for i in range(12)]  # copies but for what isn't read
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Head {k}\nBody of {k}\nEnd of {k}" for i, _, _ in rows for k in [20 if i == 20 else 0]}


@pytest.mark.parametrize("n", [2, 8, 9, 10, 12, 30])
@pytest.mark.parametrize("main", ["article", "main", "div class=story"])
def test_lines_that_every_article_has_stay_at_any_number_of_pages(spark, n, main):
    page = "<html><body><div class=wrap><div><a>Home</a></div><{1}><p>By Jane Doe</p><h2 id=search>Summary</h2><p>Text {0}</p><p>Licence: free</p></{2}><div><p>Part of the network</p></div></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i, main, main.split()[0])) for i in range(n)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows + rows[:3], "page_id bigint, url string, html string")).collect()}
    own = "By Jane Doe\nSummary\nText {}\nLicence: free"
    whole = f"Home\n{own}\nPart of the network"
    assert got == {i: (own if n > 2 else whole).format(i) for i in range(n)}


def test_identical_pages_keep_their_text_at_any_number(spark):
    html = "<html><body><div><p>one</p><p>two</p><section id='social-history'><p>three</p></section><table class='form'><tr><td>four</td></tr></table></div></body></html>"
    rows = [(i, f"http://i{n}.example/{i}", html) for n in (1, 9, 12, 40) for i in range(n)]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in got} == {"one\ntwo\nthree\nfour"}


def brute_template(pages):
    """Fixed texts of one host by occurrence vectors in plain Python."""
    counts = {}
    for i, blocks in enumerate(pages):
        for b in blocks:
            counts.setdefault(b, [0] * len(pages))[i] += 1
    kinds = {}
    for b, v in counts.items():
        kinds.setdefault(tuple(v), []).append(b)
    return {b for v, same in kinds.items() if sum(x > 0 for x in v) >= max(3, 0.9 * len(pages)) for b in same}


def test_deduction_agrees_with_occurrence_vectors(spark):
    """Flat pages: the vectors of the elements are those of the body, so every frequent text class is large enough with them only if its vector is theirs."""
    import random

    r = random.Random(4)
    hosts, rows = {}, []
    for h in range(6):
        fixed = [f"fixed {h} {k}" for k in range(r.randrange(3, 6))]
        pages = []
        for i in range(r.choice([3, 5, 11])):
            blocks = [f"own {h} {i} {k}" for k in range(r.randrange(1, 4))]
            pages.append([*fixed[:2], *blocks, *fixed[2:]])
            rows.append((100 * h + i, f"http://j{h}.example/{i}", "<html><body>" + "".join(f"<p>{x}</p>" for x in pages[-1]) + "</body></html>"))
        hosts[h] = pages
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for h, pages in hosts.items():
        gone = brute_template(pages)
        for i, blocks in enumerate(pages):
            assert got[100 * h + i] == "\n".join(b for b in blocks if b not in gone)


WRAPPERS = ["site no-sidebar", "content has-sidebar", "header-fixed", "category-social", "with-sidebar layout", "sidebar", "left-sidebar"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_names_of_wrappers_do_not_mark_the_article(spark, wrapper):
    inside = "<article><div class='article-header'><h1>Title</h1></div><header class='header'><p>By me</p></header><p>Text of the article</p></article>"
    outside = "<div class='sidebar-widget'><p>a</p></div><div id=comments><article class='comment-body'>c</article></div><div class='site-header'>d</div><div class='ad_slot-2'>e</div>"
    html = f"<html><body><div class='{wrapper}'>{inside}{outside}</div></body></html>"
    plain = html.replace("<article>", "<div>").replace("By me</p></header>", "</p></header>")
    rows = spark.createDataFrame([(1, None, html), (2, "http://g.example", plain)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract(rows).collect()}
    assert got == {1: "Title\nBy me\nText of the article", 2: "Title\nText of the article"}


def test_pages_of_a_hot_host_are_dealt_to_several_tasks(spark):
    page = "<html><body><div><p>Subscribe today for more</p></div><div><h2>H{0}</h2><p>Body of page {0} is long enough to count</p></div><div><p>All rights kept</p></div></body></html>"
    rows = [(i, "http://hot.example/x" if i % 3 else f"http://c{i % 2}.example/{i}", page.format(i)) for i in range(90)] + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    salts = {r[0]: r[1] for r in _salts(df.select(_host("url").alias("_sl_host")), len(rows), 8).collect()}
    assert salts["hot.example"] == 6 and len(salts) < 8
    assert _salts(df.limit(0).select(_host("url").alias("_sl_host")), 0, 8).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = extract(df).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.page_id is None, r.page_id or 0, r.text) for r in got) == sorted((r[0] is None, r[0] or 0, f"H{r[0]}\nBody of page {r[0]} is long enough to count" if r[2] else "") for r in rows)


def test_slots_of_a_template():
    """chars, not outside, in links, all with what is nested; once."""
    page, wrap, story = ">html>body", ">html>body>div.wrap", ">html>body>div.wrap>div.story"
    nodes = [
        (">html", 1300, 1300, 170, True), (page, 1300, 1300, 170, True), (f"{page}>ul", 200, 200, 170, True), (f"{page}>ul>li", 200, 200, 170, False),
        (wrap, 1060, 1060, 0, True), (f"{wrap}>h2", 9, 9, 0, True), (f"{wrap}>div.lead", 80, 80, 0, True), (f"{wrap}>div.top", 30, 30, 0, True), (f"{wrap}>div.top>h1", 30, 30, 0, True),
        (f"{wrap}>div.tags", 41, 41, 0, True), (story, 900, 900, 0, True), (f"{story}>p", 890, 890, 0, False),
    ]
    main, slots = article_slots(nodes)
    assert main == story
    assert dict(slots) == {
        story: False, f"{wrap}>h2": False, f"{wrap}>div.lead": False, f"{wrap}>div.top": False, f"{wrap}>div.tags": True,
        f"{page}>ul": True, wrap: True, page: True, ">html": True, "": True,
    }
    assert article_slots([]) == (None, []) and article_slots(nodes[:2]) == (None, [])
    flat = [(">html", 90, 90, 0, True), (page, 90, 90, 0, True), (f"{page}>div", 90, 90, 0, False)]
    assert article_slots(flat) == (None, [])  # an element that is there more than once is no main slot


def test_the_template_alone_finds_the_article(spark):
    page = "<html><head><title>T{0}</title></head><body><div class=x1><a href=/{0}>Go {0}</a> <a>Else {0}</a></div><div class=x2><p>Buy {0}</p></div>{2}<div class=x3><h1>Head {0}</h1><div class=x4>{1}</div></div><div class=x5>Made by {0}</div></body></html>"
    body = "".join(f"<p>Sentence number {{0}} {k} of a longer text, with some words.</p>" for k in range(6))
    want = "\n".join(["Head {0}", *[f"Sentence number {{0}} {k} of a longer text, with some words." for k in range(6)]])
    rows = [(i, f"http://k.example/{i}", page.format(i, body.format(i), "")) for i in range(9)]
    # on one page the order of two elements of the class is another: no valid class, nothing told by slots
    rows += [(100 + i, f"http://l.example/{i}", page.format(i, body.format(i), "").replace("x1", "y1" if i == 4 else "x1").replace("x5", "x1" if i == 4 else "x5").replace("y1", "x5")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract(df, names=False).collect()}
    named = {r.page_id: r.text for r in extract(df).collect()}
    assert all(got[i] == named[i] == want.format(i) for i in range(9))
    assert all(named[100 + i].startswith("Go") and named[100 + i].endswith(f"Made by {i}") for i in range(9))
    hosts = {r._sl_host: r._sl_main for r in deduce(df).collect()}
    assert hosts["k.example"] == ">html>body>div.x3>div.x4" and hosts.get("l.example") is None


def test_a_page_without_the_main_slot_keeps_its_text(spark):
    page = "<html><body><div class=a>Short {0}</div><div class=b><section><div><p>{1}</p><p>{1}</p></div></section></div></body></html>"  # b, section and div are a class of their own
    rows = [(i, f"http://m.example/{i}", page.format(i, f"text {i} " * 20)) for i in range(20)] + [(20, "http://m.example/20", "<html><body><div class=a>Only this</div><span>and that</span></body></html>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[20] == "Only this\nand that"
    assert all(got[i] == "\n".join([f"{f'text {i} ' * 20}".strip()] * 2) for i in range(20))


def test_characters_in_links():
    blocks = []
    Walk("<ul><li><a href=x>four</a> and<li><a>whole</a></ul><p>none <a>", lambda path, at: None, lambda path, text, outside, at, links: blocks.append((text, at, links)))
    assert blocks == [("four and", 3, 4), ("whole", 5, 5), ("none", 7, 0)]
