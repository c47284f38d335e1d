"""Queries of the corpus operators, and their SQL where there is one."""

from . import ctw, exact_dedup, language_id, licenses, media, minhash_dedup, mixing, packing, sharding, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_jump_sharding": sharding.op4_jump_sharding,
        "op5_language_id": language_id.op5_language_id,
        "op6_ctw_scoring": ctw.op6_ctw_scoring,
        "op7_media_copies": media.op7_media_copies,
        "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op4_jump_sharding": sharding.SQL}
