"""The queries of the training-data operators, and the SQL that must give the same rows."""

from __future__ import annotations

from stowage.llm import exact_dedup, license_scan, minhash, mixing, packing, quality_rules, sharding, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_quality_rules": quality_rules.query,
        "op3_kdtree_sharding": sharding.query,
        "op4_curriculum_mixing": mixing.query,
        "op5_minhash_near_dedup": minhash.query,
        "op6_url_filter": url_filter.query,
        "op7_bestfit_packing": packing.query,
        "op8_ftrl_toxicity": toxicity.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_license_scan": license_scan.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.oracle(),
        "op4_curriculum_mixing": mixing.ORACLE,
        "op9_exact_dedup": exact_dedup.ORACLE,
    }
