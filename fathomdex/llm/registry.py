"""The subpackage's queries and the SQL that checks them, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, html_text, huffman, media, mixing, ngram_join, packing, quality, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_huffman": huffman.op2_huffman,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality": quality.op4_quality,
        "op5_chat": chat.op5_chat,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_html": html_text.op7_html,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_packing": packing.op9_packing,
        "op10_media": media.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.OP3_SQL, "op5_chat": chat.OP5_SQL, "op6_ngram_join": ngram_join.OP6_SQL}
