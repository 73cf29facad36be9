"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions alone.

The shingles of a text are its runs of 5 words, words being ``[^\\x20\\x09-\\x0D]+`` of the
text with A-Z in lower case; with fewer words, the whole sequence is one.  A
shingle's hash is the first 12 hex digits of its MD5; the sketch keeps every
hash below a fixed fraction of their range, and the least one where none is
below.  Because the threshold is the same for all texts, sketches of
unequal texts can be compared and merged by set operations: the share of
one sketch's hashes in another estimates containment, and the overlap of two over their union
their likeness.  Two sketches of texts without words are alike (1), one of them and another are not (0).

The fingerprint is the sorted hashes, joined by commas.  A null text counts as
empty.  Rows that repeat a doc_id are documents of their own, ordered by their
texts; rows without a doc_id stand after all others in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

SHINGLE = 5
FRACTION = 1 / 8
DIGITS = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def threshold(fraction: float) -> str:
    """The least hash, as hex digits, that a sketch does not keep."""
    return format(int(fraction * 16**DIGITS), f"0{DIGITS}x")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.transform(F.array(value), body).getItem(0)


def sketch(text: Column, fraction: float = FRACTION, k: int = SHINGLE) -> Column:
    """The sketch of a text, as a sorted array of hashes."""
    split = F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    words = F.filter(split, lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))))
        return F.transform(starts, lambda i: F.substring(
            F.md5(F.array_join(F.slice(w, i, k), " ").cast("binary")), 1, DIGITS))

    def kept(h: Column) -> Column:
        return _let(F.filter(h, lambda x: x < threshold(fraction)), lambda low: F.when(
            F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(
            F.size(h) > 0, F.array(F.array_min(h))).otherwise(low))

    return _let(_let(words, hashes), kept)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketched texts."""
    return _let(F.size(F.array_intersect(a, b)), lambda common: F.when(
        F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second holds (1 if it has none)."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(sketches: Column) -> Column:
    """The sketch of several texts together, from an array of their sketches (texts without
    a hash below the threshold aside, whose least hash stays)."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def with_next_text(docs: DataFrame, columns: list[str], derive) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``, the text after it in descending order of doc_id (after the
    last comes the first), then the columns of ``derive``, then ``next_<c>`` for each of ``columns``.

    Rows are dealt into ranges of doc_id whose bounds are fixed beforehand, so one shuffle carries
    the texts; the first row of each range is added to the range above it as its end.
    """
    spark = docs.sparkSession
    low = -(2**63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("doc_id", F.lit(low)).alias("place"))
    ranges = min(shuffle_partitions(spark) * 4, 8192)
    cuts = sorted({int(x) for x in rows.approxQuantile(
        "place", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    # Two steps of about the root of their number find a row's range.
    wide = max(int(len(cuts) ** 0.5), 1)
    groups = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]
    if groups:
        table = F.array(*[F.array(*[F.lit(x) for x in g + [2**63 - 1] * (wide - len(g))]) for g in groups])
        heads = F.array(*[F.lit(g[0]) for g in groups])
        rows = rows.withColumn("outer_", F.size(F.filter(heads, lambda x: x < F.col("place"))))
        inner = F.filter(F.element_at(table, F.greatest("outer_", F.lit(1))), lambda x: x < F.col("place"))
        rows = rows.withColumn("range", F.when(F.col("outer_") == 0, 0).otherwise(
            (F.col("outer_") - 1) * wide + F.size(inner))).drop("outer_")
    else:
        rows = rows.withColumn("range", F.lit(0))
    # At most one row for each range: its largest doc_id, and the range above it (above the last: the first).
    tops = rows.groupBy("range").agg(F.max("place").alias("top"))
    above = F.coalesce(F.lead("range").over(Window.orderBy("range")),
                       F.min("range").over(Window.partitionBy()))
    tops = tops.select(F.col("range").alias("own"), "top", above.alias("above"))
    ends = (rows.join(F.broadcast(tops), (F.col("range") == F.col("own")) & (F.col("place") == F.col("top")))
            .select("doc_id", "text", "place", F.col("above").alias("range"), F.lit(1).alias("end")))
    every = rows.withColumn("end", F.lit(0)).select("doc_id", "text", "place", "range", "end").unionAll(ends)
    order = Window.partitionBy("range").orderBy("end", F.desc("place"), F.desc("text"))
    out = derive(every.withColumn("next_text", F.lead("text").over(order)))
    return (out.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
            .where("end = 0").drop("place", "range", "end"))


def edited_and_next(docs: DataFrame, fraction: float = FRACTION, k: int = SHINGLE) -> DataFrame:
    """Each document's sketch beside that of its edited text (its last half replaced by the start of the
    next document) and that of the next document: doc_id, text, edited, sketch, edited_sketch, next_sketch."""
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))")

    def derive(df: DataFrame) -> DataFrame:
        df = df.withColumn("edited", F.when(F.col("end") == 0, edited)).drop("next_text")
        return df.withColumns({"sketch": sketch(F.col("text"), fraction, k),
                               "edited_sketch": sketch(F.col("edited"), fraction, k)})

    return with_next_text(docs, ["sketch"], derive)
