"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, row_key

#: Weights of the sources in their order, repeating; no source is taken more often than this.
WEIGHTS, MOST = (5, 2, 1), 3
#: Equal blocks that a source's words are cut into (fewer if it has fewer words): so a block's size follows its own source.
BLOCKS = 1024
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """rank, source, source_size, weight and target of each source.

    Sources stand by code point, null last, and weigh weights in turn; they share the sum of all sizes, none above most
    times its size: the capped ones are a prefix in the order of size by weight, the rest divides what is left by weight.
    The windows run over one row for each source, in one task: some hundred bytes a source, so tens of millions of sources.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shared = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / shared).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min_by("level", F.struct("capped", F.col("cap") / F.col("weight"), "rank")).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return levels.select("rank", "source", "source_size", "weight", target.alias("target"))


def slot_schedule(targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """rank, slot, block, turn, begin and upto: which words of its source's line, block * width ... upto, each slot takes.

    A source's line is cut into blocks of equal width; its weight on the line of slots is the number of blocks that its target
    asks for, its last one in part. Slot i stands at the mirrored bits of i (van der Corput's sequence) on that line, whose
    cumulative weights say which source it falls to. So every beginning of the schedule has its sources near their shares, and
    all of it has them at their targets, whatever a source's size. The r-th slot of a source takes its block r modulo the number
    of its blocks. A row for each slot: blocks * 3 a source at most.
    """
    words, size, width = F.round("target").cast("long"), F.col("source_size"), F.col("width")
    plan = targets.where("source_size > 0").withColumns({"words": words, "width": F.greatest(F.lit(1), F.ceil(size / F.lit(float(blocks)))).cast("long")})
    plan = plan.withColumns({"blocks": F.expr("(source_size + width - 1) div width"), "turns": F.expr("words div source_size"), "rest": F.expr("words % source_size")})
    plan = plan.withColumn("slots", F.col("turns") * F.col("blocks") + F.expr("(rest + width - 1) div width")).where("slots > 0")
    up_to, everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    plan = plan.withColumns({"low": F.coalesce(F.sum("slots").over(up_to), F.lit(0)), "bits": F.length(F.bin(F.sum("slots").over(everything)))})
    owned = plan.withColumn("cell", F.explode(F.expr("sequence(low, low + slots - 1)")))
    owned = owned.withColumn("slot", F.conv(F.reverse(F.expr("lpad(bin(cell), bits, '0')")), 2, 10).cast("long"))
    place = F.row_number().over(Window.partitionBy("rank").orderBy("slot")) - 1
    placed = owned.withColumn("place", place).withColumns({"block": F.expr("place % blocks"), "turn": F.expr("place div blocks")})
    whole = F.col("turn") < F.col("turns")
    return placed.select("rank", "slot", "block", "turn", whole.alias("whole"), F.least((F.col("block") + 1) * width, F.when(whole, size).otherwise(F.col("rest"))).alias("upto"), "width")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """How many words of each document the mix takes.

    Returns id_col, source, size, source_size, target (of the source), taken and first_slot (the schedule's first slot that takes
    of the document; null: none), a row for each row of docs. Within its source, documents stand shuffled (by md5 of the id,
    then id and size) end to end on a line of words; a document's taken is what the scheduled blocks cover of it, repeats
    counted: at most three times its size. Each source's taken is its target rounded to a word, at every size. Null and empty
    texts have size 0 and are not taken; a null source is a source of its own, last; repeated rows count each; an empty table
    gives an empty result. Reruns agree: nothing is random.

    Shuffles: one row of numbers for each document, by (source, id prefix) for offsets, then by (source, block). Offsets are
    sums over prefix buckets plus a window inside a bucket, so no task holds a source.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = materialize(sized.withColumn("key", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))), "mix-sizes")
    targets = materialize(source_targets(sized), "mix-targets")
    taking = slot_schedule(targets, blocks).groupBy("rank", "block")
    taking = taking.agg(F.count_if("whole").alias("times"), F.max(F.when(~F.col("whole"), F.col("upto"))).alias("upto"), F.min("slot").alias("slot"))

    size = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(blocks)))).cast("long")
    known = targets.select("rank", F.col("source").alias("of"), "source_size", "target", size.alias("width"))
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    preceding = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("rank", "bucket", F.coalesce(F.sum("held").over(preceding), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = rows.join(buckets, ["rank", "bucket"]).withColumn("end", F.col("base") + F.sum("size").over(inside))
    laid = laid.select("doc_id", "source", "size", "source_size", "target", "rank", "width", (F.col("end") - F.col("size")).alias("begin"), "end")

    # In whole numbers: div keeps them exact at any size. A document of size 0 has no block.
    spans = laid.where("size > 0").withColumn("block", F.explode(F.expr("sequence(begin div width, (end - 1) div width)")))
    first, last = F.greatest("begin", F.col("block") * F.col("width")), F.least("end", (F.col("block") + 1) * F.col("width"))
    part = (last - first) * F.coalesce("times", F.lit(0)) + F.greatest(F.lit(0), F.least(last, F.coalesce("upto", F.lit(0))) - first)
    taken = spans.join(taking, ["rank", "block"], "left").withColumn("part", part).groupBy("rank", "begin", "doc_id", "source", "size", "source_size", "target")
    taken = taken.agg(F.sum("part").cast("long").alias("taken"), F.min(F.when(F.col("part") > 0, F.col("slot"))).alias("first_slot"))
    nothing = laid.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    columns = [F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "taken", "first_slot"]
    return taken.select(*columns).unionByName(nothing.select(*columns))


#: Knows nothing of slots and blocks: a source's target in words is counted off its line, turn after turn.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         COALESCE(md5(doc_id::VARCHAR), '') AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM sized GROUP BY source),
weighted AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - COALESCE(sum(cap) OVER before, 0)) / (sum(weight) OVER () - COALESCE(sum(weight) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, CASE WHEN cap <= level * weight THEN cap
    ELSE (SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, rank LIMIT 1) * weight END AS target
  FROM levels),
laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS words,
         sum(size) OVER (PARTITION BY t.rank ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS fin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0
    ELSE (words // source_size) * size + least(fin, words % source_size) - least(fin - size, words % source_size) END::BIGINT AS taken
FROM laid
"""


def repeat_by_taken(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with each row as often as the mix takes it: taken / size of its id, rounded to whole copies; columns stay, whatever their names.

    Blocks cut one document of a source at most where a turn ends, so rounding moves less than a document's words a source.
    Documents of size 0 have nothing to mix and stay once. Rows of one id have one share; ids should tell rows apart.
    """
    own = "tidemark_mix_"
    copies = mixed.groupBy(F.col(id_col).alias(f"{own}id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    n = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    copies = copies.select(f"{own}id", n.alias(f"{own}copies")).where(f"{own}copies > 0")
    joined = docs.join(copies, F.col(id_col).eqNullSafe(F.col(f"{own}id")))
    return joined.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}copies")))).select(*docs.columns)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix of all of them takes them. Rows are told apart by id and text, so null and repeated ids have shares of their own."""
    key = "tidemark_row_key"
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return repeat_by_taken(keyed, mix_sources(keyed, key, text_col, source_col, **options), key).drop(key)
