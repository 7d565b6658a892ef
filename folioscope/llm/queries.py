"""The queries of this subpackage, one for each operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from folioscope.llm import collocations, decontam, hard_negatives, html_extract, jaccard_join, language_id, license_scan, nearest, quality_rules, sharding, sp_codec, suffix_dedup, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_sharding": sharding.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_html_extract": html_extract.op4,
    "op5_license_scan": license_scan.op5,
    "op6_language_id": language_id.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_decontamination": decontam.op8,
    "op9_warc": warc.op9,
    "op10_sentencepiece": sp_codec.op10,
    "op11_nearest": nearest.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_collocations": collocations.op13,
}

ORACLE = {
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
