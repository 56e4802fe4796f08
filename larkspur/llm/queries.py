"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from larkspur.llm import decontaminate, fingerprint, jaccard_join, licenses, line_dedup, mixing, quality, sharding, url_filter, warc

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_sharding": sharding.op2_sharding,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op7_warc": warc.op7_warc,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op2_sharding": sharding.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
}
