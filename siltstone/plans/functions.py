"""String, time, hash, array, map and JSON functions, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import cosine_similarity
from siltstone.operators import build_index, recall_of, top_k_exact, top_k_indexed
from siltstone.registry import query
from siltstone.storage import cut


@query("""
select p_partkey, concat_ws('|', p_brand, p_type) as joined, regexp_extract(p_name, '([a-z]+)', 1) as word, lpad(cast(p_size as varchar), 4, '0') as padded, reverse(p_brand) as mirrored,
       cast(levenshtein(p_brand, 'Brand#11') as bigint) as far, regexp_replace(p_type, '[AEIOU]', '-', 'g') as plain, cast(length(p_name) as bigint) as size, substring(p_name, 2, 5) as part_of, upper(p_type) as loud, trim('  ' || p_brand || ' ') as bare,
       starts_with(p_brand, 'Brand#1') as first_brand, cast(instr(p_type, 'E') as bigint) as at, repeat('x', p_size % 4) as bar
from part
""")
def p40_strings(spark, t):
    return t.part.select(
        "p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("joined"), F.regexp_extract("p_name", "([a-z]+)", 1).alias("word"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.reverse("p_brand").alias("mirrored"),
        F.levenshtein("p_brand", F.lit("Brand#11")).cast("bigint").alias("far"), F.regexp_replace("p_type", "[AEIOU]", "-").alias("plain"), F.char_length("p_name").cast("bigint").alias("size"), F.substring("p_name", 2, 5).alias("part_of"),
        F.upper("p_type").alias("loud"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("bare"), F.startswith("p_brand", F.lit("Brand#1")).alias("first_brand"), F.instr("p_type", "E").cast("bigint").alias("at"), F.expr("repeat('x', p_size % 4)").alias("bar"),
    )


@query("""
select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp) as month, cast(extract(year from o_orderdate) as bigint) as y, cast(extract(doy from o_orderdate) as bigint) as doy, cast(extract(quarter from o_orderdate) as bigint) as q,
       cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) as days, strftime(o_orderdate, '%Y/%m/%d') as text, cast(last_day(o_orderdate) as timestamp) as month_end, o_orderdate + interval 36 hour as later
from orders
""")
def p41_dates(spark, t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.year(d).cast("bigint").alias("y"), F.dayofyear(d).cast("bigint").alias("doy"), F.quarter(d).cast("bigint").alias("q"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"), F.date_format(d, "yyyy/MM/dd").alias("text"), F.last_day(d).cast("timestamp_ntz").alias("month_end"), (d + F.expr("interval 36 hours")).alias("later"),
    )


@query("select doc_id, md5(text) as m, sha256(text) as s from documents")
def p42_hashes(spark, t):
    return t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), F.sha2("text", 256).alias("s"))


@query("""
with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
x as (select label, i, avg(v[i]) as c from (select label, v, unnest(range(1, 65)) as i from e) group by all),
c as (select label, list(c order by i) as c from x group by label)
select vec_id, round(list_cosine_similarity(v, c), 4) as similarity, round(list_max(v), 5) as top, cast(len(list_filter(v, lambda q: q > 0)) as bigint) as positive, round(list_sum(list_transform(v, lambda q: q * q)), 4) as square
from e join c using (label)
""")
def p43_arrays(spark, t):
    """Cosine similarity of each vector with its label's mean vector, and other array functions."""
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    mean = e.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.avg("col").alias("c"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("c"))
    return e.join(centre, "label").select(
        "vec_id", F.round(cosine_similarity(F.col("v"), F.col("c")), 4).alias("similarity"), F.round(F.array_max("v"), 5).alias("top"), F.size(F.filter("v", lambda q: q > 0)).cast("bigint").alias("positive"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, q: s + q * q), 4).alias("square"),
    )


@query("""
with g as (select user_id, event_type, count(*) as n from events group by all)
select user_id, coalesce(max(n) filter (where event_type = 'click'), 0) as clicks, max(n) * 2 as most_twice, cast(count(*) as bigint) as kinds, string_agg(event_type, ',' order by event_type) as names from g group by user_id
""")
def p44_maps(spark, t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.collect_list("event_type").alias("k"), F.collect_list("n").alias("v"))
    m = g.select("user_id", F.map_from_arrays("k", "v").alias("m"))
    twice = F.transform_values("m", lambda k, v: v * 2)
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("bigint").alias("clicks"), F.array_max(F.map_values(twice)).alias("most_twice"), F.size("m").cast("bigint").alias("kinds"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) + 1 as typed, cast(json_extract(props, '$.k') as bigint) * 2 as doubled from events")
def p45_json(spark, t):
    variant = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.from_json("props", "k bigint")["k"] + 1).alias("typed"), (variant * 2).alias("doubled"))


@query("""
select n_nationkey, cast(i as bigint) as pos, w as word from (select n_nationkey, unnest(range(0, len(string_split(n_name, 'A')))) as i, unnest(string_split(n_name, 'A')) as w from nation)
""")
def p46_generators(spark, t):
    return t.nation.select("n_nationkey", F.posexplode(F.split("n_name", "A"))).select("n_nationkey", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("word"))


@query("select n_nationkey, x.a, x.b from nation, unnest([{'a': n_regionkey, 'b': n_name}, {'a': n_regionkey + 10, 'b': 'twin'}]) as u(x)")
def p46_inline(spark, t):
    pair = F.array(F.struct(F.col("n_regionkey").alias("a"), F.col("n_name").alias("b")), F.struct((F.col("n_regionkey") + 10).alias("a"), F.lit("twin").alias("b")))
    return t.nation.select("n_nationkey", F.inline(pair))


@query("select p_partkey, cast(len(regexp_extract_all(p_type, '[AEIOU]+')) as bigint) as vowels, array_to_string(regexp_extract_all(p_name, '[a-z]+'), '-') as words from part")
def p40_all_matches(spark, t):
    return t.part.select("p_partkey", F.size(F.regexp_extract_all("p_type", F.lit("[AEIOU]+"), F.lit(0))).cast("bigint").alias("vowels"), F.array_join(F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0)), "-").alias("words"))


@query("""
with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
s as (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(q.v, e.v), 6) as similarity from e q, e where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)
select *, cast(row_number() over (partition by query_id order by similarity desc, id) as bigint) as rank from s qualify rank <= 10
""")
def p43_top_k_exact(spark, t):
    """The ten most similar vectors of each whose id is divisible by 50, against all rows in blocks."""
    found = top_k_exact(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", 10)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query("select count(*) filter (where vec_id % 50 = 0) as queries, count(*) as indexed, true as nine_of_ten_found from embeddings")
def p43_top_k_index(spark, t):
    """Every vector indexed; the same queries through the index find at least nine tenths of what the exact way finds."""
    asked = t.embeddings.filter("vec_id % 50 = 0")
    index = build_index(t.embeddings, "vec_id", "embedding", 10)
    found = cut(top_k_indexed(index, asked, "vec_id", "embedding", 10))
    recall = recall_of(found, top_k_exact(asked, t.embeddings, "vec_id", "embedding", 10))
    return recall.crossJoin(F.broadcast(index.lists.agg(F.count(F.lit(1)).alias("indexed")))).select("queries", "indexed", (F.col("recall") >= 0.9).alias("nine_of_ten_found"))


@query("""
with u as (select p_partkey, upper(p_name) as n, upper(p_type) as y from part),
x as (select p_partkey, unnest([n, y]) as w, unnest(['name', 'type']) as which from u),
c as (select p_partkey, which, w[1] as first, translate(regexp_replace(w[1] || regexp_replace(w[2:], '[HW]', '', 'g'), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202') as k from x),
r as (select p_partkey, which, first, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), 2) as k from c)
select p_partkey, which, first || substring(replace(k, '0', '') || '000', 1, 3) as code from r
""")
def p40_soundex(spark, t):
    """By sound: names and types of parts, all of which begin with a letter."""
    names = t.part.select("p_partkey", F.expr("stack(2, 'name', p_name, 'type', p_type) as (which, w)"))
    return names.select("p_partkey", "which", F.soundex("w").alias("code"))


@query("""
select o_orderkey, round((extract(year from o_orderdate) - 1995) * 12 + extract(month from o_orderdate) - 1 + (extract(day from o_orderdate) - 1) / 31, 6) as months, o_orderdate + interval 1 month + interval 2 day as later,
       cast(null as timestamp) as bad, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') as again
from orders
""")
def p41_intervals(spark, t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.round(F.months_between(d, F.lit("1995-01-01").cast("timestamp_ntz")), 6).alias("months"), (d + F.make_interval(months=F.lit(1), days=F.lit(2))).alias("later"),
        F.try_to_timestamp(F.concat(F.lit("no "), F.date_format(d, "yyyy")), F.lit("yyyy")).cast("timestamp_ntz").alias("bad"), F.try_to_timestamp(F.date_format(d, "yyyyMMdd"), F.lit("yyyyMMdd")).cast("timestamp_ntz").alias("again"),
    )


@query("select count(distinct text) as by_xxhash64, true as equal_texts_agree, true as in_range from documents")
def p42_row_hashes(spark, t):
    """64-bit hashes tell these texts apart; 32-bit ones fall into the range asked for."""
    h = t.documents.select("text", F.xxhash64("text").alias("x"), F.pmod(F.hash("text"), F.lit(16)).alias("m"))
    per = h.groupBy("text").agg(F.count_distinct("x", "m").alias("n"), F.first("x").alias("x"), F.max("m").alias("m"))
    return per.agg(F.count_distinct("x").alias("by_xxhash64"), (F.max("n") == 1).alias("equal_texts_agree"), (F.max("m") < 16).alias("in_range"))


@query("""
with g as (select user_id, event_type, count(*) as n, count(*) filter (where value > 50) as m from events group by all)
select user_id, max(n - m) as most_low, cast(sum(n * 10 + m) as bigint) as mixed from g group by user_id
""")
def p44_map_zip(spark, t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("m"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("b"))
    values = lambda f: F.map_values(F.map_zip_with("a", "b", f))
    return m.select("user_id", F.array_max(values(lambda k, x, y: x - y)).alias("most_low"), F.aggregate(values(lambda k, x, y: x * 10 + y), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("mixed"))
