"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import BLOCK_WORDS, GOLDEN, LOW_BITS, high_step

#: Production parameters of the queries.
SEQUENCE, OLD_SHARDS, NEW_SHARDS, BUCKETS = 4096, 16, 24, 10_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeats

    return drop_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_sizes

    return mixed_sizes(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .templates import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE).drop("ids")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import old_layout, reshard

    placed = reshard(_table(spark, sf_dir, "documents"), old_layout("doc_id", OLD_SHARDS), NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents")).drop("text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, min_words=20, seed=2024, max_run=1, buckets=BUCKETS)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict:
    """The functions opN_<name> of this module by N; opN_sql makes a query's SQL and is none itself."""
    named = {k: v for k, v in globals().items() if k[:2] == "op" and k[2:3].isdigit() and not k.endswith("_sql")}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(cast(doc_id as varchar) || ':mix') as h
  from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source is null, source) - 1 as rk from s0),
s2 as (select *, case rk % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s1),
s3 as (select *, cast(sum(source_size) over () - coalesce(sum(3 * source_size) over (order by source_size / weight, rk rows between unbounded preceding and 1 preceding), 0) as double)
              / cast(sum(weight) over (order by source_size / weight, rk rows between current row and unbounded following) as double) as lv from s2),
s4 as (select *, (select lv from s3 where 3 * source_size > lv * weight order by source_size / weight, rk limit 1) as cut from s3),
s5 as (select *, coalesce(least(cast(3 * source_size as double), cut * weight), cast(3 * source_size as double)) as target from s4),
tot as (select sum(target) as t from s5),
iv as (select rk, sum(target) over (order by rk) / (select t from tot) as hi from s5 where target > 0),
iw as (select rk, coalesce(lag(hi) over (order by rk), 0) as lo, case when lead(hi) over (order by rk) is null then 2 else hi end as hi from iv),
i as (select unnest(range(1, cast(ceil(floor(t + 0.5) / {BLOCK_WORDS}) as bigint) + 1)) as j from tot),
ab as (select (j >> {LOW_BITS}) * cast({high_step(GOLDEN)!r} as double) as a, (j & {(1 << LOW_BITS) - 1}) * cast({GOLDEN!r} as double) as b from i),
x as (select a - floor(a) + b - floor(b) as x from ab),
n as (select rk, count(*) as n from (select x - floor(x) as u from x) join iw on u >= lo and u < hi group by rk),
s6 as (select s5.*, cast(least(case when target <= 0 then 0 when n is null then least({BLOCK_WORDS}, floor(target + 0.5)) else n * {BLOCK_WORDS} end, 3 * source_size) as bigint) as take from s5 left join n using (rk)),
o as (select d.*, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as off from d)
select o.doc_id, o.size, s6.source_size, s6.target,
       cast(least(greatest(take - off, 0), size) + least(greatest(take - source_size - off, 0), size) + least(greatest(take - 2 * source_size - off, 0), size) as bigint) as taken
from o join s6 on o.source is not distinct from s6.source
"""

OP8_SQL = f"""
with d as (select doc_id, {_LOWER} as n from documents),
g as (select n, max(doc_id) as keep_id, count(*) as group_size from d group by n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from d join g using (n)
"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from p),
f as (select h, min(doc_id) as first_doc from x group by h),
r as (select doc_id, i from x join f using (h) where first_doc < doc_id),
c as (select distinct doc_id, unnest(range(i, i + 50)) as k from r),
t as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
y as (select t.doc_id, count(*) as n, count(c.k) as gone, coalesce(string_agg(case when c.k is null then word end, ' ' order by t.k), '') as kept
      from t left join c on t.doc_id = c.doc_id and t.k = c.k group by t.doc_id)
select d.doc_id, coalesce(n, 0) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join y using (doc_id)
"""


OP9_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as h
      from (select doc_id, w, unnest(case when len(w) >= 5 then range(1, len(w) - 3) when len(w) > 0 then [1] else [] end) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by all),
l as (select x, y from i join n as nx on nx.doc_id = x join n as ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
e as (select x as u, y as v from l union all select y, x from l),
r as (select doc_id as u, doc_id as c from d union select e.v, r.c from r join e on e.u = r.u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from d left join n using (doc_id) join (select u as doc_id, min(c) as component_id from r group by u) m using (doc_id)
"""


def op10_sql(line_documents: int = 20, line_share: float = 0.02, depleted: float = 0.5) -> str:
    return f"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, {_WORDS} as w from documents),
l as (select r, source, md5(t) as content, unnest(string_split(t, chr(10))) as line from d),
m as (select *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as lw from l),
n as (select r, source, content, line, len(lw) as k, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from m where len(lw) > 0),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from n group by r),
freq as (select source, norm, count(distinct content) as c from n group by all),
host as (select source, count(distinct md5(t)) as h from d group by all),
common as (select f.source, f.norm from freq f join host on f.source is not distinct from host.source where c > {line_documents} and c > h * {line_share}),
boil as (select r, sum(k) as b from n join common c on n.source is not distinct from c.source and n.norm = c.norm group by r),
win as (select r, i, md5(array_to_string(w[i:i + 4], ' ')) as x from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
rep as (select r, x from win group by all having count(*) > 1),
cov as (select r, count(*) as n_repeat_words from (select distinct win.r, unnest(range(i, i + 5)) as k from win join rep on win.r = rep.r and win.x = rep.x) group by r),
f as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, cast(coalesce(b, 0) as bigint) as n_boilerplate_words
      from d left join dup using (r) left join cov using (r) left join boil using (r))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_boilerplate_words <= n_words * {depleted} as kept from f
"""


OP11_SQL = rf"""
with bits as (select cast(b as bigint) as b from range(256) x(b)),
r1 as (select b, case when b & 1 = 1 then xor(b >> 1, 3988292384) else b >> 1 end as c from bits),
r2 as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from r1),
r3 as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from r2),
r4 as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from r3),
r5 as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from r4),
r6 as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from r5),
r7 as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from r6),
r8 as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from r7),
tab as (select list(c order by b) as l from r8),
d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
m as (select regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select r, word, count(*) as n from (select r, unnest(w) as word from d) group by all),
q as (select word, count(*) as n from (select unnest(w) as word from m) group by all),
v as (select distinct word from (select word from p union all select word from q)),
x as (select word, hex(encode(word)) as h from v),
y as (select word, list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda k: cast('0x' || substr(h, cast(k as int), 2) as bigint))) as l from x),
b as (select word, xor(list_reduce(y.l, lambda c, e: xor(c >> 8, tab.l[cast(xor(c & 255, e) + 1 as int)])), 4294967295) % {BUCKETS} as bucket from y, tab),
s as (select bucket, sum(n) as s from p join b using (word) group by bucket),
t as (select bucket, sum(n) as t from q join b using (word) group by bucket),
g as (select bucket, cast(floor(1000 * ln((cast(coalesce(t, 0) as double) + 1) * (cast((select coalesce(sum(s), 0) from s) as double) + {BUCKETS})
        / ((cast(coalesce(s, 0) as double) + 1) * (cast((select coalesce(sum(t), 0) from t) as double) + {BUCKETS})))) as bigint) as gain from s full join t using (bucket)),
u as (select r, sum(n) as n, sum(n * gain) as total from p join b using (word) join g using (bucket) group by r),
w as (select d.doc_id, len(w) as n_words, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce((total - ((total % n) + n) % n) // n, 0) as bigint) as weight,
             cast('0x' || substr(sha256('2024:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) as h from d left join u using (r)),
z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from w),
o as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as turn from z)
select doc_id, n_features, weight, score, case when n_words >= 20 and turn <= (select count(*) from z where n_words >= 20) * 10 // 100 then turn end as rank from o
"""

OP12_SQL = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term from (select distinct r, lang, term from o) group by all having count(*) >= 10),
v as (select lang, count(*) as v from kept group by lang),
grp as (select distinct lang, source from d),
c0 as (select lang, source, term, count(*) as c from o join kept using (lang, term) group by all),
c as (select g.lang, g.source, k.term, coalesce(c0.c, 0) as c from grp g join kept k using (lang) left join c0 on c0.lang = g.lang and c0.source = g.source and c0.term = k.term),
n as (select lang, source, sum(c) as n from c group by all),
p as (select lang, source, term, c, 1 + (1000000000::hugeint * (c + 2)) // (n + 2 * v) as p from c join n using (lang, source) join v using (lang)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(c) + 2)) // (any_value(m) + 2 * any_value(v)) as q from c join v using (lang) join (select lang, sum(n) as m from n group by lang) using (lang) group by all),
pair as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
          from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from p join q using (lang, term) where c > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": OP11_SQL, "op12_source_divergence": OP12_SQL, "op10_quality_rules": op10_sql(), "op9_near_duplicates": OP9_SQL, "op2_substring_dedup": OP2_SQL, "op3_mixing": OP3_SQL, "op8_exact_dedup": OP8_SQL}
