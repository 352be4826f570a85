"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size in words. All sources share the mix in
proportion to their weights; a source stops at ``MAX_EPOCHS`` times its
size and what it leaves is shared again, until no source is above. A
source's target is met by whole passes over it plus one partial pass: its
documents in seeded hash order, whole ones first, the last one for as many
words as are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushwin.llm.common import WORD, scope, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hex digits of the order key that make a bucket; bucket sums find where a partial pass ends.
BUCKET_DIGITS = 4
#: Sources (plan rows of some 100 bytes) that are broadcast; beyond, salts per source.
BROADCAST_SOURCES = 20_000
SALTS = 64


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int = SEED) -> Column:
    """Seeded place of a document within its source: a hash of its id, in
    hex. Rows that share an id (or have none) share a place and are taken in
    equal proportion."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words, order key. A null text has size 0; a null source is a source."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       word_count("text").alias("size"), order_key(seed).alias("key"))


def fill(source_sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sorted by cap over weight, the capped sources are a prefix: a source is
    capped if its share of what the earlier ones leave exceeds its cap. One
    row per source, so the two global windows see a list of sources, never
    documents."""
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int")).cast("long")
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_rank"))
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = (source_sizes.withColumn("_rank", rank).withColumn("_weight", weight).withColumn("_cap", cap)
         .withColumn("_total", F.sum("source_size").over(all_rows))
         .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         .withColumn("_weights", F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
         .withColumn("_full", F.col("_cap").cast("double") * F.col("_weights") <= F.col("_weight").cast("double") * F.col("_left")))
    capped = F.col("_full")
    left = F.col("_total") - F.coalesce(F.sum(F.when(capped, F.col("_cap"))).over(all_rows), F.lit(0))
    weights_left = F.sum(F.when(~capped, F.col("_weight"))).over(all_rows)
    target = F.when(capped, F.col("_cap").cast("double")).otherwise((F.col("_weight") * left).cast("double") / weights_left)
    return t.withColumn("target", target).select("source", "source_size", "target")


def plan(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: size, target, whole passes, and where the
    partial pass ends (``cut_key``; rows at that key, ``cut_size`` words
    together, give ``cut_words``). ``sized`` is read three times: stage it.

    The end is found in two steps: sums per hash bucket (combined map-side,
    so a source with a third of all rows costs no more than another) pick
    the bucket, and only the rows of that bucket are put in order."""
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    per_source = sums.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    quota = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0))
    targets = (fill(per_source, weights, max_epochs).withColumn("quota", quota).withColumn("whole", whole.cast("long"))
               .withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut_bucket = (sums.withColumn("upto", F.sum("words").over(running)).alias("s")
                  .join(targets.select(F.col("source").alias("t_source"), "rest"), F.col("source").eqNullSafe(F.col("t_source")))
                  .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
                  .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
                          (F.col("rest") - (F.col("upto") - F.col("words"))).alias("b_rest")))
    inside = (sized.withColumn("bucket", bucket)
              .join(cut_bucket, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
              .groupBy("source", "b_rest", "key").agg(F.sum("size").alias("at_key")))
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (inside.withColumn("upto", F.sum("at_key").over(by_key))
            .where((F.col("upto") > F.col("b_rest")) & (F.col("upto") - F.col("at_key") <= F.col("b_rest")))
            .select(F.col("source").alias("c_source"), F.col("key").alias("cut_key"), F.col("at_key").alias("cut_size"),
                    (F.col("b_rest") - (F.col("upto") - F.col("at_key"))).alias("cut_words")))
    return (targets.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
            .select(F.col("source").alias("plan_source"), "source_size", "target", "whole", "cut_key", "cut_size", "cut_words"))


def with_plan(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``rows`` with their source's plan columns (``plans`` is staged). The plan has one row per
    source: it is counted, and broadcast up to ``BROADCAST_SOURCES`` rows, so
    rows stay where they are. Beyond that it is joined by source and a salt,
    each source's rows being dealt over ``SALTS`` tasks."""
    if plans.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plans), F.col("source").eqNullSafe(F.col("plan_source")))
    salted = plans.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("key", "doc_id"), F.lit(SALTS)).cast("int")
    return (rows.withColumn("salt", salt).join(salted, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("salt") == F.col("plan_salt")))
            .drop("salt", "plan_salt"))


def taken() -> Column:
    """Words taken of a row that has its source's plan columns, its size and its key."""
    extra = (F.when(F.col("key") < F.col("cut_key"), F.col("size"))
             .when(F.col("key") == F.col("cut_key"), F.expr("size * cut_words div cut_size"))
             .otherwise(F.lit(0)))
    return (F.col("whole") * F.col("size") + extra).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    The words taken of a source sum to its target, rounded, exactly (less
    one word at most for each row that shares the id at the cut); no row
    gives more than ``max_epochs`` times its size. Reruns agree: the order
    depends on seed and id only. An empty table gives no rows."""
    sized = staged(sizes(docs, seed), "mix-sizes")
    joined = with_plan(sized, staged(plan(sized, weights, max_epochs), "mix-plan"))
    return joined.select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every row as often as
    the mix takes it; a partial repetition holds the text's first words, up
    to the end of the last word taken. Rows of size 0 give no words and are
    left out; ``n_chars``, if present, follows the text."""
    with scope(docs.sparkSession):
        plans = staged(plan(staged(sizes(docs, seed), "mix-sizes"), weights, max_epochs), "mix-plan", keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       "doc_id", F.col("source").cast("string").alias("source"),
                       word_count("text").alias("size"), order_key(seed).alias("key"), F.col("text").alias("text"))
    rows = (with_plan(rows, plans)
            .withColumn("taken", taken()).where(F.col("taken") > 0)
            .withColumn("copies", F.expr("taken div size")).withColumn("part", F.expr("taken % size")))
    spaced = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(spaced, 1, F.col("part").cast("int")), "")
    rows = rows.select("row", "part", F.explode(F.concat(
        F.array_repeat(F.lit(None).cast("string"), F.col("copies").cast("int")),
        F.when(F.col("part") > 0, F.array(head)).otherwise(F.array().cast("array<string>")))).alias("head"))
    fields = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.coalesce(F.col("head"), value)
        elif c == "n_chars":
            value = F.coalesce(F.length("head").cast(docs.schema[c].dataType), value)
        fields.append(value.alias(c))
    return rows.select(*fields)
