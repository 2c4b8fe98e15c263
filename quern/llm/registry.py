"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm import bpe, chat, exact_dedup, fill_middle, hard_negatives, language_id, licenses, mixing, near_dup, repair_shards, shards, token_counts, vp_search


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_shard_compaction": shards.op2_shard_compaction,
        "op3_repair_shards": repair_shards.op3_repair_shards,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_language_id": language_id.op5_language_id,
        "op6_vp_tree_search": vp_search.op6_vp_tree_search,
        "op7_pfair_mixing": mixing.op7_pfair_mixing,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_setsketch_near_dup": near_dup.op9_setsketch_near_dup,
        "op10_bpe_round_trip": bpe.op10_bpe_round_trip,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_chat_format": chat.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_shard_compaction": shards.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op7_pfair_mixing": mixing.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
        "op12_fill_middle": fill_middle.ORACLE,
        "op13_chat_format": chat.ORACLE,
    }
