"""The ten queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, fingerprints, licenses, neardup, packing, pii, quality, substring, tokenbin, warc

QUERIES = {
    "op1_minhash_near_dedup": neardup.op1_minhash_near_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
    "op7_token_ids": tokenbin.op7_token_ids,
    "op8_warc": warc.op8_warc,
    "op9_pii": pii.op9_pii,
    "op10_substring_dedup": substring.op10_substring_dedup,
}

ORACLE_SQL = {
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_substring_dedup": substring.OP10_SQL,
}
