"""Chat formatting with cumulative-snapshot collapse.

Chats are often logged anew after every turn, so a log holds many conversations that are the
beginning of a longer one.  A rolling hash over each conversation's turns
(four 32-bit sums of hashes of position, role and text, 128 bits in all) names each of its
beginnings.  Equal conversations keep the one with the smallest conv_id; an
anti-join with the proper beginnings of all conversations then leaves the maximal ones, and only these are rendered.

Turns are numbered by ordered scans that split a long conversation over many
tasks, and a conversation is rendered in segments of at most ``segment_turns``
turns, so none is ever gathered in one place; its text is its segments in order.

Rows without conv_id or turn belong to no conversation and take no part.  A
row that repeats counts once; different rows of one turn stand in order of
role and text.  A null role or text counts as empty.  Template markers inside roles and texts
are broken up by a space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SEGMENT_TURNS = 256
# Fixed values of the template.
START, END, MARKER = "<|im_start|>", "<|im_end|>\n", "<|"
_LANES = ["lane0", "lane1", "lane2", "lane3"]


def _lane_hashes() -> dict:
    """Four 32-bit hashes of a turn at its position; their sums stay far inside a long."""
    out = {}
    for i in range(2):
        h = F.xxhash64(F.lit(1000 + i), "pos", "h0", "h1")
        out[f"lane{2 * i}"] = h.bitwiseAND(0xFFFFFFFF)
        out[f"lane{2 * i + 1}"] = F.shiftrightunsigned(h, 32)
    return out


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Every distinct turn once, dealt by ranges of (conv_id, turn, role, text): ``at`` follows that order, and
    ``chunk`` is the range.  Checkpointed, as all that follows must see one dealing."""
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    rows = (turns.where("conv_id is not null and turn is not null")
            .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                    F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(n, *order).distinct().sortWithinPartitions(*order)
    return cut_lineage(dealt.withColumn("at", F.monotonically_increasing_id())
                       .withColumn("chunk", F.spark_partition_id()))


def _offsets(per_chunk: DataFrame, sums: list[str]) -> DataFrame:
    """For each (conv_id, chunk), the sums over the conversation's earlier chunks."""
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select("conv_id", "chunk", *[
        F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(f"before_{c}") for c in sums])


def _local():
    return Window.partitionBy("conv_id", "chunk").orderBy("at")


def with_positions(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, chunk, at, ...) with ``pos``, their place in the conversation from 1."""
    counts = _offsets(rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")), ["n"])
    return (rows.withColumn("local", F.row_number().over(_local()).cast("long")).join(counts, ["conv_id", "chunk"])
            .withColumn("pos", F.col("before_n") + F.col("local")).drop("local", "before_n"))


def prefixes(ordered: DataFrame) -> DataFrame:
    """(conv_id, pos, lanes, own_lanes): each turn with the hash of the beginning that ends with it, and its own.

    Only hashes of the texts move here.
    """
    rows = with_positions(ordered.select(
        "conv_id", "chunk", "at", F.xxhash64(F.lit(1), "role", "text").alias("h0"),
        F.xxhash64(F.lit(2), "text", "role").alias("h1")))
    rows = rows.withColumns({f"own_{c}": h for c, h in _lane_hashes().items()})
    sums = _offsets(rows.groupBy("conv_id", "chunk").agg(*[F.sum(f"own_{c}").alias(c) for c in _LANES]), _LANES)
    running = _local().rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumns({f"sum_{c}": F.sum(f"own_{c}").over(running) for c in _LANES})
            .join(sums, ["conv_id", "chunk"])
            .select("conv_id", "pos", *[(F.col(f"before_{c}") + F.col(f"sum_{c}")).alias(c) for c in _LANES],
                    *[f"own_{c}" for c in _LANES]))


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one goes on from."""
    whole = rolled.groupBy("conv_id").agg(F.max(F.struct("pos", *_LANES)).alias("whole"))
    kept = (whole.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
            .select("conv_id", "n_copies", "whole.*"))
    # A turn shows that what stands before it is a proper beginning.
    before = [(F.col(c) - F.col(f"own_{c}")).alias(c) for c in _LANES]
    proper = rolled.where("pos > 1").select((F.col("pos") - 1).alias("pos"), *before).distinct()
    return (kept.join(proper, ["pos", *_LANES], "left_anti")
            .select("conv_id", F.col("pos").alias("n_turns"), "n_copies"))


def render(ordered: DataFrame, kept: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(conv_id, segment, n_turns, n_copies, text): the conversations of ``kept`` in the template."""
    clean = {c: F.replace(F.col(c), F.lit(MARKER), F.lit("< |")) for c in ("role", "text")}
    line = F.concat(F.lit(START), clean["role"], F.lit("\n"), clean["text"], F.lit(END))
    rows = with_positions(ordered.join(kept.select("conv_id"), "conv_id", "left_semi"))
    return (rows.select("conv_id", "pos", line.alias("line"),
                        F.floor((F.col("pos") - 1) / segment_turns).cast("int").alias("segment"))
            .groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
            .join(kept, "conv_id")
            .select("conv_id", "segment", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("text")))


def format_chats(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """The maximal conversations of ``turns`` (conv_id, turn, role, text; other columns are not read), rendered."""
    ordered = ordered_turns(turns)
    return render(ordered, cut_lineage(maximal(prefixes(ordered))), segment_turns)
