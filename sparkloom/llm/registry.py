"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_packing, byte_bpe, fill_in_middle, jaccard_join, language_id, lm_scoring, mpeg_audio, near_dedup, oracles, quality_rules, secret_scans, sharding, spelling_variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_best_fit_packing": best_fit_packing.op3_best_fit_packing,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_language_id": language_id.op5_language_id,
    "op6_mpeg_audio": mpeg_audio.op6_mpeg_audio,
    "op7_sharding": sharding.op7_sharding,
    "op8_warc": warc.op8_warc,
    "op9_secret_scans": secret_scans.op9_secret_scans,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_minhash_near_dedup": near_dedup.op12_minhash_near_dedup,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.quality_rules(),
    "op7_sharding": oracles.sharding(),
    "op9_secret_scans": oracles.secret_scans(),
    "op11_fill_in_middle": oracles.fill_in_middle(),
    "op12_minhash_near_dedup": oracles.near_dedup(),
    "op13_spelling_variants": oracles.spelling_variants(),
}
