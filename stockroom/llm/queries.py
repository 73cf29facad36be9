"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_collapse, edit_counts, language_id, norm_search, one_bit_codes, oracles, packing, piece_match,
               scaled_sketch, secret_scan, set_join, substring_dedup, turn_repair, whitening)
from .common import table


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations (none is the beginning of another) in the chat template, in segments."""
    return chat_collapse.format_chats(table(spark, sf_dir, "conversations"))


def op2_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by cosine, of every vector whose id is divisible by 50."""
    return one_bit_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    s = scaled_sketch
    out = s.edited_and_next(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", ",").alias("fingerprint"), F.array_join("edited_sketch", ",").alias("edited_fingerprint"),
        s.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        s.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        s.containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, a digest of their spans, and all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*secret_scan.BASE_KINDS))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document left after removing 13-word windows that start in an earlier document."""
    out = substring_dedup.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def edit_requests(docs: DataFrame) -> DataFrame:
    """Stand-in edits: three for each document, made from its own columns."""
    sized = docs.select("doc_id", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    return sized.selectExpr("doc_id", """stack(3,
        0, n div 3, n div 3 + 7, source,
        1, 2 * (n div 3), 2 * (n div 3), concat(' ', lang, "'s "),
        2, 0L, 1L, '') as (seq, start, stop, replacement)""")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its edits."""
    docs = table(spark, sf_dir, "documents")
    return edit_counts.follow_edits(docs, edit_requests(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into pieces and packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of at least 0.75."""
    return set_join.link_components(table(spark, sf_dir, "documents"))


def op10_piece_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in SentencePiece ids and back: their number, digests of both, and whether the text came back."""
    docs = table(spark, sf_dir, "documents")
    back = piece_match.decode_ids(piece_match.encode_texts(docs))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("text_sha256"))


def op11_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every vector whose id is divisible by 100."""
    return norm_search.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first eight whitened components, its exact deviation, and how far their covariance is from the identity."""
    rows, fits, errors = whitening.whiten(table(spark, sf_dir, "embeddings"))
    facts = [(dim, f.n, errors.get(dim), [float(e / f.trace) for e in f.eigenvalues]) for dim, f in fits.items()]
    known = spark.createDataFrame(facts, "dim int, n long, identity_error double, shares array<double>")  # a row for each length
    out = rows.join(F.broadcast(known), "dim")
    return out.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error",
                      F.posexplode(F.arrays_zip("whitened", "shares")).alias("at", "x")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"),
        F.col("x.shares").alias("explained"), "identity_error")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after stated damage, its cheapest repair, and a digest of the repaired turns."""
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repaired(conversations, turn_repair.damage(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_collapse, op2_one_bit_neighbours, op3_scaled_sketch, op4_secret_scan, op5_language_id,
        op6_substring_dedup, op7_edit_counts, op8_packing, op9_ngram_jaccard_join, op10_piece_match,
        op11_norm_search, op12_whitening, op13_turn_repair)}

ORACLES: dict[str, str] = {
    "op1_chat_collapse": oracles.CHATS, "op2_one_bit_neighbours": oracles.NEIGHBOURS,
    "op3_scaled_sketch": oracles.FINGERPRINTS, "op6_substring_dedup": oracles.PASSAGES,
    "op9_ngram_jaccard_join": oracles.COMPONENTS,
    "op11_norm_search": oracles.PRODUCTS, "op13_turn_repair": oracles.REPAIRS}
