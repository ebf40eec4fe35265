"""The queries of the training-data operators, and their SQL where it can say them."""

from __future__ import annotations

from . import ann, bpe, chat, exact_dedup, line_dedup, ngram_join, packing, pii, quality, sharding


def queries():
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_ann": ann.op2_ann,
        "op3_packing": packing.op3_packing,
        "op4_chat_format": chat.op4_chat_format,
        "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
        "op6_quality": quality.op6_quality,
        "op7_bpe": bpe.op7_bpe,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_pii": pii.op9_pii,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql():
    return {
        "op1_sharding": sharding.SQL,
        "op4_chat_format": chat.SQL,
        "op5_ngram_jaccard": ngram_join.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
    }
