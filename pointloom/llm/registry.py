"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pointloom.llm import exact_dedup, language_id, merkle, mixing, ngram_join, oracles, packing, quality_classifier, quality_rules, release, secrets, sharding, substring_dedup, token_output


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_secret_scans": secrets.op3_secret_scans,
        "op4_sharding": sharding.op4_sharding,
        "op5_packing": packing.op5_packing,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_token_output": token_output.op9_token_output,
        "op10_mixing": mixing.op10_mixing,
        "op11_language_id": language_id.op11_language_id,
        "op12_release": release.op12_release,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": oracles.OP1,
        "op2_quality_rules": oracles.OP2,
        "op6_substring_dedup": oracles.OP6,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op12_release": release.OP12_SQL,
        "op13_merkle": merkle.OP13_SQL,
    }
