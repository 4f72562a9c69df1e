"""The queries of the training-data operators, one for each, and the SQL for those that SQL can express."""

from . import langid, license_scan, media, minhash, mixing, packing, quality, secret_scan, substring, token_count

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_language_id": langid.op4_language_id,
    "op5_token_counts": token_count.op5_token_counts,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_packing": packing.op7_packing,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_media_gif": media.op10_media_gif,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op8_license_scan": license_scan.oracle(),
}
