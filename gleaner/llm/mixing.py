"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import ROW, Scratch, running_sum, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 128  # words in a block
SEED = 42
CELLS = 4096  # parts of the schedule that sources are looked up by
GOLDEN = 2_654_435_769  # 2^32 divided by the golden ratio
PERIOD = 1 << 30  # slots after which the points start anew; keeps the products below 2^63


def source_targets(
    sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, place, source_size, target) from rows of (source, size).

    Sources lie in code point order, null last, and take the weights in turn. They share share times all
    sizes by weight; a target stops at most times its source's size, and what is over is shared again by
    weight among the others until no target is above. Only sums over the source table come to the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = running_sum(sources, order, F.lit(1), "place", scratch)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = scratch.keep(placed.withColumn("weight", turn).withColumn("cap", F.col("source_size") * float(most)))
    wanted = (placed.agg(F.sum("source_size")).first()[0] or 0) * share
    capped, rate = F.lit(False), 0.0
    while True:
        open_weight = F.sum(F.when(~capped, F.col("weight")).otherwise(0.0))
        row = placed.agg(open_weight, F.sum(F.when(capped, F.col("cap")).otherwise(0.0))).first()
        if not row[0] or (next_rate := (wanted - row[1]) / row[0]) <= rate:
            break
        rate = next_rate
        capped = F.col("cap") <= F.col("weight") * rate
    target = F.least(F.col("cap"), F.col("weight") * rate)
    return placed.select("source", "place", "source_size", target.alias("target"))


def source_schedule(sources: DataFrame, scratch: Scratch, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(place, slot, block, pass): which block of which source every slot of the schedule takes.

    Slot t is the golden-ratio point frac(t / phi), mapped through the cumulative numbers of blocks that the
    targets need; so every stretch of slots holds each source nearly in proportion. The slots of a source are
    ranked, and rank r takes block r mod the source's blocks, in pass r div that number.
    """
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    need = F.ceil(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    need = F.least(need, F.col("blocks") * most)
    parts = sources.where("source_size > 0").withColumn("blocks", blocks).withColumn("need", need)
    parts = scratch.keep(running_sum(parts, [F.col("place")], F.col("need"), "first", scratch))
    slots = parts.agg(F.sum("need")).first()[0] or 0
    cells = F.sequence(
        F.floor(F.col("first") * CELLS / slots), F.floor((F.col("first") + F.col("need") - 1) * CELLS / slots)
    )
    parts = parts.where("need > 0").withColumn("cell", F.explode(cells))
    point = (F.col("slot") % PERIOD) * GOLDEN % (1 << 32)
    at = F.floor(point / float(1 << 32) * slots)
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot")).withColumn("at", at)
    points = points.withColumn("cell", F.floor(F.col("at") * CELLS / max(1, slots)))
    inside = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("need"))
    taken = points.join(parts, "cell").where(inside).select("place", "slot", "blocks")
    ranked = running_sum(taken, [F.col("place"), F.col("slot")], F.lit(1), "rank", scratch)
    firsts = ranked.groupBy("place").agg(F.min("rank").alias("first_rank"))
    ranked = ranked.join(firsts, "place").withColumn("rank", F.col("rank") - F.col("first_rank"))
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
    return ranked.where(F.col("pass") < most).select("place", "slot", (F.col("rank") % F.col("blocks")).alias("block"), "pass")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, text_hash) of every row.

    Each source's documents lie end to end in a seeded order and are cut into blocks of equally many words;
    the schedule's slots are joined to the blocks, and taken is what the slots take of a document, repeats
    counted: at most `most` times its size. Orders come from hashes of seed, doc_id and text, so reruns
    agree however the rows are dealt.

    A null text has size 0 and takes 0; a null source is one source, the last; a null doc_id is an id like
    any other. Repeated rows each have their own place. An empty table gives no rows. Nothing is grouped by
    source alone: documents and slots are ordered by (source, hash or slot) in range partitions, so a source
    with a third of all rows spans many of them.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"),
    )
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    sources = scratch.keep(source_targets(rows, scratch, weights, share, most))
    schedule = scratch.keep(source_schedule(sources, scratch, most, block))
    times = schedule.groupBy("place", "block").agg(F.count(F.lit(1)).alias("times"))

    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "text_hash"))
    order = [F.col("source").isNull(), F.col("source"), draw, F.col("doc_id"), F.col("text_hash"), F.col("row")]
    laid = running_sum(rows, order, F.col("size"), "start", scratch)
    first = laid.groupBy("source").agg(F.min("start").alias("first"))
    named = sources.join(first, sources["source"].eqNullSafe(first["source"])).drop(first["source"])
    laid = laid.join(named, laid["source"].eqNullSafe(named["source"])).drop(named["source"])
    laid = scratch.keep(laid.withColumn("start", F.col("start") - F.col("first")))

    end = F.col("start") + F.col("size")
    pieces = laid.where("size > 0").select(
        "row", "place", "start", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"),
    )
    length = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    pieces = pieces.join(times, ["place", "block"]).select("row", (length * F.col("times")).alias("words"))
    taken = pieces.groupBy("row").agg(F.sum("words").alias("words"))
    out = laid.join(taken, "row", "left")
    return out.select(
        "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "text_hash"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them.

    Whole documents are taken: one that the mix takes in part comes once more for that part, so a row comes
    at most MOST times, and a source's words differ from its target by less than a document and a block. Rows
    without words are not part of a mix and go.
    """
    taken = mix_sources(docs, id_col, text_col, source_col)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = taken.where("taken > 0").groupBy("doc_id", "text_hash").agg(F.max(copies).alias("_copies"))
    copies = copies.select(F.col("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_hash"), "_copies")
    rows = docs.select(
        F.struct("*").alias(ROW),
        F.col(id_col).cast("long").alias("_id"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_hash"),
    )
    same = F.col("_id").eqNullSafe(F.col("_mix_id")) & (F.col("_hash") == F.col("_mix_hash"))
    repeated = rows.join(copies, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(f"{ROW}.*")
