"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import checks, toxicity
from .chat_format import digests, format_chats
from .decontaminate import decontaminate, shown_matches
from .merkle import manifest
from .mixing import mix
from .near_dedup import NearDup, near_groups
from .quality_classifier import score, train
from .quality_rules import quality_rules
from .registry import query, table
from .sharding import shard_documents
from .spelling import spelling_forms
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .warc import archive_round_trip


@query("op1_near_dedup", checks.NEAR_DEDUP)
def op1_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), NearDup(shingle_words=2))


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op8_decontaminate", checks.DECONTAMINATE)
def op8_decontaminate(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), matches=True)
    return shown_matches(found)


@query("op2_shard")
def op2_shard(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


@query("op9_chat_format", checks.CHAT_FORMAT)
def op9_chat_format(spark, sf_dir):
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digests(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)))


@query("op10_mix")
def op10_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


@query("op4_remove_repeats")
def op4_remove_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op3_warc", checks.WARC)
def op3_warc(spark, sf_dir):
    back = archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_merkle_manifest", checks.MERKLE)
def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))


@query("op11_spelling_forms", checks.SPELLING)
def op11_spelling_forms(spark, sf_dir):
    return spelling_forms(table(spark, sf_dir, "documents"))


@query("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
