"""The registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import bpe, exact, html, licenses, lm, packing, pii, runs, simhash, substrings, syncmers, toxicity, trie
from .common import read

BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor of every text and of its edited text, and likeness over all of them."""
    found = syncmers.with_neighbours(read(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, BYTE_FILE, BYTE_RANKS).select("doc_id", "ids")
    decoded = bpe.decode(encoded, BYTE_FILE, BYTE_RANKS)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under a model of the documents labelled good, less the loss under one of all."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    marked = docs.join(broadcast_if_small(good, good.count(), 32), "doc_id", "left")
    return lm.score(marked, marked.where("is_target"), BYTE_FILE, BYTE_RANKS)


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of the corpus in sequences of 4096."""
    return packed(read(spark, sf_dir, "documents").select("doc_id", "text"))


def packed(docs: DataFrame) -> DataFrame:
    cut = packing.pieces(docs.select("doc_id", "text"), WORD_FILE)
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(cut)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract(pages, html.learn(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labelled rows outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    tagged = toxicity.score(docs, model)
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return tagged.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), places.alias("spans")
    )


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 400-byte strings that also start elsewhere."""
    kept = substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), n_words=51)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_grams", "n_shared_words")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of each stays."""
    return exact.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by fingerprints that differ in at most two bits."""
    found = simhash.components(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: what the patterns find, and what the network adds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the conversations after each got its beginning from the first of its hundred."""
    turns, members = trie.rebuilt(trie.numbered(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return trie.prefix_trie(turns, members)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every text, every tenth of which repeats its end."""
    docs = runs.planted(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases in every text, and the labels of templates that accept a stretch of it."""
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base, more = (F.transform(c, lambda x: x["label"]) for c in ("places", "stretches"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_bpe_round_trip,
        op3_cross_entropy_difference,
        op4_pack_documents,
        op5_main_text,
        op6_toxicity,
        op7_remove_repeats,
        op8_exact_dedup,
        op9_simhash_components,
        op10_personal_data,
        op11_prefix_trie,
        op12_periodic_runs,
        op13_license_wording,
    )
}

SQL = {
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                     row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS r
              FROM d WINDOW w AS (PARTITION BY t))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = 1 AS kept, sha256(t) AS text_sha256
        FROM n
    """,
}
