"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Each source's documents are shuffled by a seeded hash and laid end to end; the line is cut into
blocks of ``BLOCK_WORDS`` words. A schedule of slots draws the sources: slot i has the golden-ratio
point frac(i / phi), which falls into one of the sources' cumulative weights. The r-th slot of a
source takes block r modulo its blocks, so a source that must give more than it has repeats from
its first block. Slots beyond a source's quota are dropped, missing ones (a few, by the schedule's
discrepancy) follow at the end, and the last block of a quota is cut to the word, so a source gives
its target to within one word.

Ranks and running sums are taken in two levels (chunks of bounded size, then the chunks' totals),
so a source with any share of the rows is spread over many tasks.

Defined cases: a null source is a source of its own and the last; a null or blank text has no words
and is never taken; repeated rows count and are taken separately; an empty table gives no rows;
further columns are ignored. Ties of the shuffle are broken by id and size. Reruns agree.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.runtime import cut

#: Fixed by the contract: a word, the weights in code-point order of the sources, the repeat limit.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 1024
SEED = 20_240_601
#: Documents or slots that one window holds.
CHUNK = 8192
_CELLS = 2048
_LOW = 1 << 20
#: Beginning of names that no table of documents has.
_OWN = "__linkforge_"
getcontext().prec = 60
_PHI = (Decimal(5).sqrt() - 1) / 2
#: Golden-ratio steps of one slot and of 2^20 slots, so that points stay exact for large slot numbers.
STEP, LONG_STEP = float(_PHI), float(_PHI * _LOW % 1)


def sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, h): words of the whole text and the place in the shuffle."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: its words, target, quota of words and of slots, and its slot interval.

    Targets fill up by weight: with sources in order of limit / weight, the level is the first one
    that its own source's limit exceeds. The windows here hold one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    choice = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(choice, (F.col("source_no") % len(weights) + 1).cast("int"))).withColumn("most", repeats * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - before) / rest).withColumn("place", F.row_number().over(by_limit))
    free = F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct("place", "level"))
    per = per.withColumn("level", F.min(free).over(everything)["level"])
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double"))
    per = per.withColumn("target", target).withColumn("quota", F.least("most", F.round("target").cast("long")))
    s, b = F.greatest(F.col("source_size"), F.lit(1)), block_words
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / b)).withColumn("epochs", F.floor(F.col("quota") / s)).withColumn("rest", F.col("quota") - F.col("epochs") * s)
    per = per.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / b))
    return per.withColumn("slot_stop", F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, 0))).withColumn("slot_start", F.col("slot_stop") - F.col("slots")).drop("level", "place", "weight", "most")


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot, in [0, 1)."""
    x = F.floor(slot / _LOW) * LONG_STEP + (slot % _LOW) * STEP
    return x - F.floor(x)


def schedule(per: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(slot, source_no, rank): which source every slot draws, and how often it was drawn before."""
    spark = per.sparkSession
    total = per.agg(F.sum("slots")).first()[0] or 0
    width = max(1, -(-total // _CELLS))
    spans = per.where("slots > 0").select("source_no", "slot_start", "slot_stop", F.explode(F.sequence(F.floor(F.col("slot_start") / width), F.floor((F.col("slot_stop") - 1) / width))).alias("cell"))
    parts = max(spark.sparkContext.defaultParallelism, total // 2_000_000)
    slots = spark.range(0, total, 1, parts).select(F.col("id").alias("slot"), F.least(F.floor(point(F.col("id")) * total), F.lit(total - 1)).alias("p"))
    slots = slots.withColumn("cell", F.floor(F.col("p") / width)).withColumn("chunk", F.floor(F.col("slot") / chunk))
    drawn = slots.join(spans, "cell").where((F.col("p") >= F.col("slot_start")) & (F.col("p") < F.col("slot_stop"))).select("slot", "chunk", "source_no")
    counts = drawn.groupBy("source_no", "chunk").count()
    until = F.sum("count").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("count")
    counts = counts.withColumn("first", until)
    rank = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("r", rank).join(counts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("first") + F.col("r")).alias("rank"))
    have = counts.groupBy("source_no").agg(F.sum("count").alias("have"))
    short = per.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    late = short.select("source_no", "slot_start", F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"))
    late = late.select((F.lit(total) + F.col("slot_start") + F.col("rank")).alias("slot"), "source_no", "rank")
    quota = per.select("source_no", F.col("slots").alias("quota_slots"))
    return ranked.unionByName(late).join(quota, "source_no").where("rank < quota_slots").select("slot", "source_no", "rank")


def draws(per: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source_no, block, words): the block each slot takes, and how much of it."""
    own = schedule(per).join(per.select("source_no", "blocks", "epochs", "rest"), "source_no")
    own = own.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    words = F.when(F.col("epoch") < F.col("epochs"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - F.col("block") * block_words))
    return own.select("slot", "source_no", "block", words.cast("long").alias("words"))


def placed(sized: DataFrame, per: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sized`` with source_no and [start, stop): the words' place in the shuffled source."""
    own = sized.join(per.select(F.col("source").alias("s"), "source_no", "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    own = own.withColumn("chunk", F.floor((F.col("h") / float(1 << 64) + 0.5) * F.ceil(F.col("n") / chunk)))
    totals = own.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("first", F.sum("words").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("words")).drop("words")
    inside = F.sum("size").over(Window.partitionBy("source_no", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("inside", inside).join(totals, ["source_no", "chunk"]).withColumn("stop", F.col("first") + F.col("inside"))
    return own.withColumn("start", F.col("stop") - F.col("size")).select("doc_id", "size", "source_no", "start", "stop")


def slices(lines: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, block, doc_id, size, start, low, high): every document's part of every block."""
    b = block_words
    cuts = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("stop") - 1) / b))
    own = lines.where("size > 0").withColumn("block", F.explode(cuts))
    low, high = F.greatest(F.col("start") - F.col("block") * b, F.lit(0)), F.least(F.col("stop") - F.col("block") * b, F.lit(b))
    return own.select("source_no", "block", "doc_id", "size", "start", low.alias("low"), high.alias("high"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: (slot, source_no, doc_id, size, from_word, to_word), in slot order when sorted.

    ``from_word`` and ``to_word`` count the document's own words.
    """
    sized = cut(sizes(docs, doc_id, source, text), "sizes")
    per = cut(targets(sized, block_words=block_words), "targets")
    parts = slices(placed(sized, per), block_words)
    own = draws(per, block_words).join(parts, ["source_no", "block"]).withColumn("high", F.least("high", "words")).where("low < high")
    shift = F.col("block") * block_words - F.col("start")
    return own.select("slot", "source_no", "doc_id", "size", (F.col("low") + shift).alias("from_word"), (F.col("high") + shift).alias("to_word"))


def taken(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and the words that the mix takes."""
    sized = cut(sizes(docs, doc_id, source, text), "sizes")
    per = cut(targets(sized, block_words=block_words), "targets")
    lines = placed(sized, per)
    whole = F.col("words") == block_words
    drawn = draws(per, block_words).groupBy("source_no", "block").agg(F.count_if(whole).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("words"))), F.lit(0)).alias("part"))
    got = F.col("times") * (F.col("high") - F.col("low")) + F.greatest(F.least("high", "part") - F.col("low"), F.lit(0))
    own = slices(lines, block_words).join(drawn, ["source_no", "block"], "left").withColumn("got", F.coalesce(got, F.lit(0)))
    out = own.groupBy("doc_id", "size", "source_no", "start").agg(F.sum("got").alias("taken")).drop("start")
    out = out.unionByName(lines.where("size = 0").select("doc_id", "size", "source_no", F.lit(0).cast("long").alias("taken")))
    return out.join(per.select("source_no", "source", "source_size", "target"), "source_no").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, to the nearest whole copy.

    At most one document per source is taken in part. Texts without words are kept once; repeated
    rows share what their id and size is taken for.
    """
    got = taken(docs, doc_id, source, text).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("t"), F.count(F.lit(1)).alias("rows"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("t") / (F.col("rows") * F.greatest("size", F.lit(1))))).cast("int")
    got = got.select(F.col("doc_id").alias(_OWN + "id"), F.col("source").alias(_OWN + "source"), F.col("size").alias(_OWN + "size"), copies.alias(_OWN + "copies")).where(F.col(_OWN + "copies") > 0)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col(doc_id).eqNullSafe(F.col(_OWN + "id")) & F.col(source).eqNullSafe(F.col(_OWN + "source")) & (size == F.col(_OWN + "size"))
    return docs.join(got, same).withColumn(_OWN + "copy", F.explode(F.array_repeat(F.lit(1), F.col(_OWN + "copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
