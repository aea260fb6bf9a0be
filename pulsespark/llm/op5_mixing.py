"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsespark.llm._common import documents, free_name, shared_dir, stored

#: The fractional part of the golden ratio: slot i of the schedule falls on the point frac(i * GOLDEN).
GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Words of a block at most, slots of a schedule at least where blocks can be that small, and slots dealt out together.
BLOCK = 4096
SLOTS = 1 << 17
RANGE = 1 << 14
#: Cells of the unit interval that slots meet sources in (a power of 2), and documents of a source placed together.
CELLS = 1 << 10
GROUP = 1 << 10


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, source_size) with weight and target: words to take from each source.

    Sources by code point, null last, weigh `weights`, repeating. Targets share the sum of all sizes by weight; none
    is above `epochs` times its source's size, what is above goes to the others by weight. In closed form: with sources
    sorted by cap / weight, the first k are at their cap, where k is the least number for which the next source's share
    of the rest stays below its cap. One row a source, so the windows here are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * epochs)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("rest", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("share", F.col("rest") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(everything)["share"])
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(plan: DataFrame, total: int, block: int) -> DataFrame:
    """(source_no, rank) of the blocks to take, each once: plan has source_no, low, high (cumulative shares), need (blocks).

    Slot i goes to the source whose share holds frac(i * GOLDEN). Ranks within a source are counted per range of slots
    first, then prefix sums over ranges are added, so that no task sees all slots of a source. Slots past a source's need
    stay idle; blocks that the schedule leaves short come after it. A slot meets only the sources of its cell of the unit
    interval, by an equi-join (points spread evenly over the cells, so none is hot).
    """
    spark = plan.sparkSession
    n = max(1, -(-total // block))
    slots = spark.range(n).select((F.col("id") / RANGE).cast("long").alias("range"), "id", F.expr(f"id * {GOLDEN}D - floor(id * {GOLDEN}D)").alias("point"))
    ends = [F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)) for c in ("low", "high")]
    cells = plan.withColumn("cell", F.explode(F.sequence(*ends)))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).join(cells, "cell").where("point >= low and point < high").select("range", "id", "source_no", "need")
    counts = slots.groupBy("source_no", "range").agg(F.count(F.lit(1)).alias("n"))
    prefix = counts.select("source_no", "range", (F.sum("n").over(Window.partitionBy("source_no").orderBy("range")) - F.col("n")).alias("before"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("source_no", "range").orderBy("id")) - 1).join(prefix, ["source_no", "range"])
    ranked = ranked.select("source_no", (F.col("before") + F.col("r")).cast("long").alias("rank"), "need").where("rank < need").drop("need")
    have = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    short = plan.join(have, "source_no", "left").select("source_no", F.coalesce("n", F.lit(0)).alias("n"), "need").where("n < need")
    return ranked.union(short.select("source_no", F.explode(F.sequence(F.col("n").cast("long"), F.col("need") - 1)).alias("rank")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, text_hash, epoch, taken, size, source_size, target): words that the mix takes of each document and epoch.

    Each source's documents, shuffled by a hash of id and text, form a stream of words that repeats `epochs` times and is
    cut into blocks of equal size; the schedule picks blocks, and a document gives the words of it that lie in them. The
    last block of a source ends at its target, rounded. No document gives more than `epochs` times its size. Epochs
    start at 0; a document that gives nothing has one row with epoch 0 and taken 0. Null and empty texts have size 0
    and give nothing; a null source is a source of its own. Repeated rows are documents of their own. Reruns agree.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"))
    base = stored(base, "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    plan = targets(sizes, weights, epochs).withColumn("goal", F.round("target").cast("long"))
    facts = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.max("docs"), F.lit(0)).alias("n")).first()
    total, most = int(facts["t"]), int(facts["n"])
    block = min(BLOCK, max(1, total // SLOTS))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("source_no", F.row_number().over(order)).withColumn("need", F.ceil(F.col("goal") / block))
    plan = plan.withColumn("high", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1e-9)))
    plan = stored(plan.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("high", F.when(F.lead("source_no").over(order).isNull(), 2.0).otherwise(F.col("high"))), "plan")
    blocks = schedule(plan.where("goal > 0").select("source_no", "low", "high", "need"), total, block)

    # places in the shuffled stream: sums per group of neighbours in the shuffle first, so a hot source is many groups
    groups = max(1, most // GROUP)
    placed = base.join(plan.select(F.col("source").alias("s"), "source_no", "source_size", "target", "goal"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    placed = placed.withColumn("g", F.pmod(F.shiftright("h", 20), F.lit(groups)))
    sums = placed.groupBy("source_no", "g").agg(F.sum("size").alias("n"))
    before = sums.select("source_no", "g", (F.sum("n").over(Window.partitionBy("source_no").orderBy("g")) - F.col("n")).alias("before"))
    within = Window.partitionBy("source_no", "g").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(within)).withColumn("k", F.row_number().over(within)).join(before, ["source_no", "g"])
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("size"))

    pieces = placed.where("size > 0 and goal > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    pieces = pieces.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")).where("lo < goal").withColumn("hi", F.least(F.col("lo") + F.col("size"), "goal"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    pieces = pieces.withColumn("words", F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block))
    got = pieces.join(blocks, ["source_no", "rank"]).groupBy("source_no", "g", "h", "k", "epoch").agg(F.sum("words").alias("taken"))
    out = placed.select("source_no", "g", "h", "k", "doc_id", "size", "source_size", "target").join(got, ["source_no", "g", "h", "k"], "left")
    return out.select("doc_id", F.col("h").alias("text_hash"), F.coalesce("epoch", F.lit(0)).alias("epoch"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "size", "source_size", "target", "source_no", "k")


def taken(mixed: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words over all epochs)."""
    sums = mixed.groupBy("doc_id", "text_hash", "source_no", "k", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return sums.select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mixed documents: a row of docs for each epoch that takes it, all columns as they were.

    Documents stay whole: one that a source's target cuts is in that epoch if the mix takes at least half of it. Texts
    without words are in no epoch. Rows that repeat id and text are mixed each by itself, and each row then comes in every
    epoch that takes one of them. Columns of docs may have any names; an empty table gives none.
    """
    name, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    times = mix_sources(docs, seed=seed, **options).where("taken > 0 and 2 * taken >= size")
    i, h, n, c, k = (free_name(docs, x) for x in ("_mix_id", "_mix_hash", "_mix_times", "_mix_copy", "_mix_key"))
    times = times.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.countDistinct("epoch").alias(n))
    keyed = docs.withColumn(k, F.xxhash64(F.lit(seed), F.col(name), F.col(text)))
    joined = keyed.join(times, (keyed[name].eqNullSafe(times[i])) & (keyed[k] == times[h]))
    return joined.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; see mix_sources for nulls, ties and repeated rows."""
    return taken(mix_sources(documents(spark, sf_dir)))
