"""Registered queries of the subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import (
    chat_format, cover_search, decontaminate, importance, lang_id, main_text, packing, secret_scan, sim_hash, suffix_dedup, target_draw,
    token_mix, turn_repair,
)
from tessera.llm.common import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op2_secrets")
def op2(spark, sf_dir):
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


@query("op3_main_text")
def op3(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op4_chat_format")
def op4(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", clash), (-1, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    return chat_format.format_chats(turns.unionByName(extra))


@query("op10_mix", token_mix.ORACLE)
def op10(spark, sf_dir):
    weights = token_mix.quality_weights(table(spark, sf_dir, "labels"))
    return token_mix.mix_words(table(spark, sf_dir, "documents"), weights)


@query("op8_simhash")
def op8(spark, sf_dir):
    return sim_hash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_top_k")
def op9(spark, sf_dir):
    return cover_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_lang_id")
def op6(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents"))


@query("op5_quality")
def op5(spark, sf_dir):
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query("op11_pack")
def op11(spark, sf_dir):
    from public_tokenizers import path
    return packing.pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


@query("op12_turn_repair")
def op12(spark, sf_dir):
    return turn_repair.audits(turn_repair.damaged(table(spark, sf_dir, "conversations")))


@query("op13_target_draw", target_draw.ORACLE)
def op13(spark, sf_dir):
    return target_draw.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))
