"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import (
    audit, decontam, exact_dedup, hpylm, htmltext, jaccard, langid, neardup, packing, sharding, toxicity, warc, zonemaps,
)
from corpusloom.llm.common import id_remainder, table
from corpusloom.llm.oracles import ORACLES  # noqa: F401
from corpusloom.session import shared_path

N_SHARDS = 16
TOXIC_AT = 0.3
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """The public vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_hpylm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hpylm.score(docs, id_remainder("doc_id", 10) != 0)


def op2_warc_transactions(spark, sf_dir):
    path = shared_path(spark, "archives")
    warc.write_archives(warc.capture_records(table(spark, sf_dir, "pages")), path)
    found = warc.captures(spark, path, keep_payload=False)
    response, described = F.col("response"), F.col("metadata")[0]["fields"]
    return found.select(
        described["captureid"].cast("long").alias("page_id"),
        response["fields"]["content-length"].cast("long").alias("payload_bytes"),
        # of a response the digest of what was read, of a revisit the one it declares
        F.coalesce(response["payload_digest"], response["declared_digest"]).alias("payload_digest"),
        response["record_type"].alias("record_type"),
        response["refers_to"].cast("long").alias("refers_to"),
    )


def op3_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        decontam.items_digest().alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def toxic_model(spark, sf_dir):
    """The toxicity model of the query and the pipeline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 4) != 2)


def op4_toxic_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxic_model(spark, sf_dir))
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        "spans",
    )


def op5_byte_shards(spark, sf_dir):
    sized = sharding.sized(table(spark, sf_dir, "documents"))
    placed = sharding.byte_shards(sized, N_SHARDS, order=("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    identifier = langid.fit(docs, id_remainder("doc_id", 5) != 0)
    return langid.identify(docs.select("doc_id", "text"), identifier).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_ngram_jaccard_join(spark, sf_dir):
    groups = jaccard.similar_groups(table(spark, sf_dir, "documents"), percent=90, width=3)
    return groups.select("doc_id", "n_shingles", "component_id")


def op9_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_main_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_centroid_clusters(spark, sf_dir):
    return zonemaps.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, salt="3:")


def op12_filter_audit(spark, sf_dir):
    counts = audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.filter_interactions(counts)


def op13_embedding_near_dedup(spark, sf_dir):
    return neardup.near_groups(table(spark, sf_dir, "embeddings"), cosine=0.9)


QUERIES = {
    "op1_hpylm_score": op1_hpylm_score,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxic_spans": op4_toxic_spans,
    "op5_byte_shards": op5_byte_shards,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_pack": op9_pack,
    "op10_main_text": op10_main_text,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_filter_audit": op12_filter_audit,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
