"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

The wanted total is shared by weight. A source that would be repeated more than `max_epochs` times stops there, and
what it leaves goes to the others by weight until none is above its limit. In closed form: sort the sources by
limit / weight; source i is clamped iff the level that would remain after clamping everything before it still exceeds
its own limit / weight.

A target is then met by whole and fractional repetitions: every document is taken floor(target / size) times, and
the rest by whole documents in a seeded random order until the target is reached; the one document that crosses it
gives only its first words (or, with whole=True, counts in full if that is nearer). To find that document no source
is ever sorted as a whole: the order is by a hash, its leading bits are the bucket, word counts are summed by
(source, bucket), and ranks are taken within a bucket only.

Defined results: null text has size 0. Null is a source of its own, ordered last. Rows that repeat count each for
itself. A source of size 0 has target 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import stage, table

WORD = r"[^\x20\x09-\x0D]+"
#: Leading bits of the hash that make a bucket: a source is split into so many parts.
BUCKET_BITS = 10


def keyed(df: DataFrame) -> DataFrame:
    """With join keys under which a null source equals itself."""
    return df.withColumns({"source_key": F.coalesce(F.col("source"), F.lit("")), "source_null": F.col("source").isNull()})


def word_count(text: str = "text") -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target for each row of sources(source, source_size). One row a source, so one window holds them."""
    ranked = sources.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("clamped", F.col("level") * F.col("weight") >= F.col("cap"))
    # The first source that isn't clamped gives the level of all that follow.
    final = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "i", "level"))).over(everything)["level"]
    return ranked.withColumn("final", final).select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repetitions (whole ones), extra (words of a further, partial one) for each row."""
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    sized = stage(sized.withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS)), "sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    plan = sources.withColumn("repetitions", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("repetitions") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    starts = keyed(starts).drop("source").join(keyed(plan).drop("source"), ["source_key", "source_null"])
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed(sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))))
    left = F.col("rest") - F.col("start") - F.col("ahead")
    extra = F.when(2 * left > F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least("size", left))
    out = ranked.join(starts, ["source_key", "source_null", "bucket"]).withColumn("extra", extra.cast("long"))
    taken = (F.col("repetitions") * F.col("size") + F.col("extra")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", "repetitions", "extra", taken)


def mixed_documents(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """The rows of docs as often as the mix takes them, as whole documents; all columns stay."""
    taken = mix_sources(docs, weights, share, max_epochs, seed, whole=True)
    key = ["_id", "_source", "_size"]
    taken = taken.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    taken = stage(taken.agg(F.sum(F.col("repetitions") + (F.col("extra") > 0).cast("long")).alias("_all"), F.count("*").alias("_rows")), "taken")
    sized = docs.withColumn("_words", word_count())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    found = sized.join(taken, same)
    # Rows of one id, source and size share what is taken of them.
    own = F.row_number().over(Window.partitionBy(*key).orderBy("text"))
    several = found.filter("_rows > 1").withColumn("_own", own).withColumn("_all", F.expr("_all div _rows") + (F.col("_own") <= F.col("_all") % F.col("_rows")).cast("long")).drop("_own")
    every = found.filter("_rows = 1").unionByName(several).filter("_all > 0")
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_all")))).select(*docs.columns)


#: The weights of the query.
WEIGHTS = [3.0, 1.0, 2.0]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")
