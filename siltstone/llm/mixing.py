"""Mixing sources to target weights with a low-discrepancy schedule.

Method: slot i of the schedule takes the golden-ratio point frac((i + 1) * 0.618...), which
is mapped through the cumulative target shares to a source. The slots of a source are
ranked; rank r gets the r-th block of BLOCK_WORDS words of the source's shuffled stream of
documents, which starts again when it is used up. So the words that a source gives are its
slots times a block: the low discrepancy of the points brings them within a few blocks of
the target. After `passes` times its source the stream ends, so no word is taken more often
than that, whatever the schedule does.

Targets: source weights cycle through `weights` over the sources in code point order (null
last) and share the total of all sizes. A source whose share is above `passes` times its
size stops there and the excess goes to the others by weight, until none is above. That is
one threshold on size / weight, found from sorted running sums.

Scale: slots and documents are dealt by ranges of their running sums, so a source with a
third of all rows is cut into as many pieces as it needs. Only one row per source is ever
in a single task, and only one number per partition is collected.

Defined cases: a null or empty text has size 0 and takes 0 words. A null source is a source
of its own. A source without words has target 0. A source with a target too small for the
schedule to reach gets one slot of its own after the others. Rows repeated with the same id
each count. Reruns agree: the shuffle is by MD5 of the id and the seed.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import free

from .common import WORD, cut, prefix_sums, with_plain_names

GOLDEN = 0.6180339887498949
#: Words of a slot, cells of the unit interval, words of a bin of the stream.
BLOCK_WORDS, CELLS, BIN_WORDS = 128, 1024, 1024
#: Points are made from the upper and lower part of the slot's number, so that they stay exact at any number of slots.
LOW_BITS = 20


def high_step(step: float) -> float:
    """frac(step * 2**LOW_BITS), exactly rounded."""
    return float(Fraction(step) * (1 << LOW_BITS) % 1)


def point(number, step: float):
    """frac(number * step) of a bigint column."""
    high = F.shiftright(number, LOW_BITS).cast("double") * high_step(step)
    low = number.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("double") * step
    both = (high - F.floor(high)) + (low - F.floor(low))
    return both - F.floor(both)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = 3) -> DataFrame:
    """One row per source: source, _sl_rank, source_size, weight, target (words)."""
    one = Window.partitionBy(F.lit(0))
    by_code = one.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("_sl_rank", F.row_number().over(by_code) - 1)
    src = src.withColumn("weight", F.element_at(cycle, (F.col("_sl_rank") % len(weights)).cast("int") + 1).cast("bigint"))
    # sources in the order in which they would reach their limit as the level rises
    rising = one.orderBy(F.col("source_size") / F.col("weight"), "_sl_rank")
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    later = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(one)
    level = (total - F.coalesce(F.sum(F.col("source_size") * passes).over(earlier), F.lit(0))).cast("double") / F.sum("weight").over(later).cast("double")
    src = src.withColumn("_sl_level", level)
    # the level holds from the first source that it leaves below its limit
    free = F.when(F.col("source_size") * passes > F.col("_sl_level") * F.col("weight"), F.struct(F.row_number().over(rising).alias("at"), "_sl_level"))
    src = src.withColumn("_sl_free", free).withColumn("_sl_level", F.min("_sl_free").over(one)["_sl_level"]).drop("_sl_free")
    limit = (F.col("source_size") * passes).cast("double")
    return src.withColumn("target", F.coalesce(F.least(limit, F.col("_sl_level") * F.col("weight")), limit)).drop("_sl_level")


def _stream(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_sl_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)).cast("binary")).alias("_sl_h"),
    )


def _within(df: DataFrame, value: str, out: str) -> DataFrame:
    """`out` less its least value in each source (by _sl_rank)."""
    first = df.groupBy("_sl_rank").agg(F.min(out).alias("_sl_first"))
    return df.join(F.broadcast(first) if _few(first) else first, "_sl_rank").withColumn(out, F.col(out) - F.col("_sl_first")).drop("_sl_first")


def _few(df: DataFrame, limit: int = 10_000) -> bool:
    """Whether df has at most `limit` rows, so that it may be broadcast."""
    return df.limit(limit + 1).count() <= limit


def _mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    passes: int = 3, seed: str = ":mix", block_words: int = BLOCK_WORDS, step: float = GOLDEN,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, segments, points) of mix(); segments also have _sl_pass.

    step: the distance of the schedule's points. points: the documents without words whose
    place is reached, once each: slot, _sl_pass, _sl_row and _sl_off (place in the pass).
    """
    spark = docs.sparkSession
    sizes = cut(_stream(docs, id_col, text_col, source_col, seed))
    src = cut(source_targets(sizes, weights, passes))
    few = _few(src)

    # slots -> sources, by cells of the unit interval
    total = src.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    n_slots = -(-int(total + 0.5) // block_words)
    order = Window.partitionBy(F.lit(0)).orderBy("_sl_rank")
    live = src.filter("target > 0").select("_sl_rank", "target", "source_size")
    upto = F.sum("target").over(order) / F.lit(total or 1.0)
    live = live.withColumn("_sl_hi", upto).withColumn("_sl_lo", F.coalesce(F.lag("_sl_hi").over(order), F.lit(0.0)))
    live = live.withColumn("_sl_hi", F.when(F.lead("_sl_hi").over(order).isNull(), F.lit(2.0)).otherwise(F.col("_sl_hi")))
    live = cut(live)
    cells = live.withColumn("_sl_cell", F.explode(F.sequence(F.floor(F.col("_sl_lo") * CELLS), F.least(F.floor(F.col("_sl_hi") * CELLS), F.lit(CELLS - 1)))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point(F.col("id") + 1, step).alias("_sl_u"))
    slots = slots.withColumn("_sl_cell", F.least(F.floor(F.col("_sl_u") * CELLS), F.lit(CELLS - 1)))
    placed = slots.join(F.broadcast(cells) if few else cells, "_sl_cell").filter("_sl_u >= _sl_lo and _sl_u < _sl_hi").select("slot", "_sl_rank").withColumn("_sl_one", F.lit(1).cast("bigint"))
    placed = cut(_within(prefix_sums(placed, ["_sl_rank", "slot"], "_sl_one", "rank", "_sl_slot_row"), "_sl_one", "rank").select("slot", "_sl_rank", "rank"))
    used = placed.groupBy("_sl_rank").agg(F.count(F.lit(1)).alias("_sl_slots"))
    missed = live.join(used, "_sl_rank", "left_anti").select((F.lit(n_slots) + F.col("_sl_rank")).cast("bigint").alias("slot"), "_sl_rank", F.lit(0).cast("bigint").alias("rank"))
    # what a source gives: a block for each of its slots, as far as its passes go
    given = F.when(F.col("_sl_slots").isNull(), F.least(F.lit(block_words), F.floor(F.col("target") + 0.5))).otherwise(F.col("_sl_slots") * block_words)
    taken = live.join(used, "_sl_rank", "left").select("_sl_rank", F.least(given, F.col("source_size") * passes).cast("bigint").alias("_sl_take"))
    src = cut(src.join(taken, "_sl_rank", "left").withColumn("_sl_take", F.coalesce("_sl_take", F.lit(0).cast("bigint"))))
    held = F.broadcast(src) if few else src

    ranked = sizes.join(held, sizes["source"].eqNullSafe(src["source"])).select(sizes["*"], "_sl_rank", "source_size", "target", "_sl_take")
    stream = _within(prefix_sums(ranked, ["_sl_rank", "_sl_h", "_sl_id", "size"], "size", "_sl_off", "_sl_row"), "size", "_sl_off")
    stream = cut(stream)
    free(sizes)

    # rank -> block of the endless stream -> places in its passes, by bins of the stream
    sliced = placed.unionByName(missed).join(held.select("_sl_rank", "_sl_take", "source_size"), "_sl_rank")
    sliced = sliced.withColumn("_sl_a", F.col("rank") * block_words).withColumn("_sl_b", F.least((F.col("rank") + 1) * block_words, F.col("_sl_take")))
    sliced = sliced.filter("_sl_b > _sl_a and source_size > 0").withColumn("_sl_pass", F.explode(F.expr("sequence(_sl_a div source_size, (_sl_b - 1) div source_size)")))
    here = F.col("_sl_pass") * F.col("source_size")
    sliced = sliced.withColumn("_sl_from", F.greatest(F.col("_sl_a") - here, F.lit(0))).withColumn("_sl_to", F.least(F.col("_sl_b") - here, F.col("source_size")))
    bins = lambda lo, hi: F.explode(F.expr(f"sequence({lo} div {BIN_WORDS}, ({hi} - 1) div {BIN_WORDS})"))
    left = sliced.select("slot", "rank", "_sl_pass", F.col("_sl_rank").alias("_sl_source"), "_sl_from", "_sl_to", bins("_sl_from", "_sl_to").alias("_sl_bin"))
    ends = stream.filter("size > 0").withColumn("_sl_end", F.col("_sl_off") + F.col("size"))
    right = ends.select("_sl_row", "_sl_id", "source", "_sl_rank", "_sl_off", "_sl_end", bins("_sl_off", "_sl_end").alias("_sl_at"))
    start, stop = F.greatest("_sl_from", "_sl_off"), F.least("_sl_to", "_sl_end")
    met = left.join(right, (left["_sl_source"] == right["_sl_rank"]) & (left["_sl_bin"] == right["_sl_at"]))
    met = met.filter((start < stop) & (F.expr(f"greatest(_sl_from, _sl_off) div {BIN_WORDS}") == F.col("_sl_bin")))
    segments = met.select("slot", "_sl_pass", "source", "rank", "_sl_row", F.col("_sl_id").alias(id_col), (start - F.col("_sl_off")).alias("start"), (stop - start).alias("length"))
    empty = stream.filter("size = 0 and source_size > 0 and _sl_off < _sl_take")
    empty = empty.select("_sl_row", F.col("_sl_rank").alias("_sl_in"), F.expr("_sl_off div source_size").alias("_sl_turn"), (F.col("_sl_off") % F.col("source_size")).alias("_sl_off"))
    empty = empty.withColumn("_sl_at", F.expr(f"_sl_off div {BIN_WORDS}"))
    held = left.join(empty, (left["_sl_source"] == empty["_sl_in"]) & (left["_sl_pass"] == empty["_sl_turn"]) & (left["_sl_bin"] == empty["_sl_at"]))
    points = held.filter("_sl_from <= _sl_off and _sl_off < _sl_to").select("slot", "_sl_pass", "_sl_row", "_sl_off")
    documents = stream.withColumnRenamed("_sl_id", id_col)
    return documents, segments, points


def mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, segments).

    documents: a row per input row with its id, size, source, source_size, target, _sl_row
    (a key of the row), _sl_off (its place in its source's stream) and _sl_take (words of the
    stream that the schedule takes, all passes together).
    segments: the mix itself, in the order of slot: slot, source, rank, _sl_row, id, start (first
    word in the document) and length.
    """
    documents, segments, _ = _mix(docs, **options)
    return documents, segments.drop("_sl_pass")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words of all its segments)."""
    id_col = options.get("id_col", "doc_id")
    documents, segments = mix(docs, **options)
    taken = segments.groupBy("_sl_row").agg(F.sum("length").alias("taken"))
    return documents.join(taken, "_sl_row", "left").select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", passes: int = 3, **options) -> DataFrame:
    """docs as the mix uses them, in the order of its slots: a row for each pass that begins the document (0 to `passes` of them).

    A row stands where the slot stands that takes the document's first word in that pass.
    Whole texts are kept: the document at which a pass of its source ends stays whole. A
    document without words stays once if its place in the stream is reached; those of a
    source without words, which has no slot, come last.
    """
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    return with_plain_names(docs, tuple(names.values()), lambda d: _mixed_documents(d, passes=passes, **names, **options))


def _mixed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, passes: int, **options) -> DataFrame:
    documents, segments, points = _mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, passes=passes, **options)
    key = ["_sl_key", "_sl_from", "_sl_size"]
    rows = documents.select("_sl_row", F.col(id_col).alias("_sl_key"), F.col("source").alias("_sl_from"), F.col("size").alias("_sl_size"), F.col("_sl_off").alias("_sl_place"), "source_size")
    begun = segments.filter("start = 0").select("slot", "_sl_pass", "_sl_row").unionByName(points.drop("_sl_off"))
    used = rows.join(begun, "_sl_row").select(*key, F.col("slot").alias("_sl_slot"), "_sl_pass", "_sl_place")
    last = rows.filter("source_size = 0").select(*key, F.lit(1 << 62).alias("_sl_slot"), F.lit(0).cast("bigint").alias("_sl_pass"), "_sl_place")
    used = cut(used.unionByName(last))
    kin = [F.col(id_col), F.col(source_col).cast("string"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")]
    texts, turn = docs.select("*", *[c.alias(f"_sl_own{i}") for i, c in enumerate(kin)]), F.lit(True)
    again = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_sl_rows")).filter("_sl_rows > 1"))
    if again.limit(1).count():
        # rows alike in id, source and size share their uses in turn, in an order of their texts that reruns keep
        met = [used[k].eqNullSafe(again[k]) for k in key]
        used = used.join(again, reduce(lambda a, b: a & b, met), "left").select(used["*"], F.coalesce("_sl_rows", F.lit(1)).alias("_sl_rows"))
        at = F.row_number().over(Window.partitionBy(*key).orderBy("_sl_slot", "_sl_pass", "_sl_place"))
        used = used.withColumn("_sl_turn", (at - 1) % F.col("_sl_rows") + 1)
        texts = texts.withColumn("_sl_own", F.row_number().over(Window.partitionBy(*[f"_sl_own{i}" for i in range(3)]).orderBy(F.md5(F.col(text_col).cast("binary")))))
        turn = F.col("_sl_own") == F.col("_sl_turn")
    same = [texts[f"_sl_own{i}"].eqNullSafe(used[k]) for i, k in enumerate(key)]
    return texts.join(used, reduce(lambda a, b: a & b, same, turn)).orderBy("_sl_slot", "_sl_pass", "_sl_place").select(*docs.columns)
