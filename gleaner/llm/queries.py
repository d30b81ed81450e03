"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from gleaner.llm import ann, brown_lm, conversation_repair, decontaminate, filter_audit, license_scan, mixing, quality, sentencepiece_fst, simhash, suffix_dedup, url_filter, warc


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_source_mix": mixing.op4_source_mix,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_ann_forest": ann.op7_ann_forest,
        "op8_warc_index": warc.op8_warc_index,
        "op9_brown_lm": brown_lm.op9_brown_lm,
        "op10_sentencepiece": sentencepiece_fst.op10_sentencepiece,
        "op11_decontaminate": decontaminate.op11_decontaminate,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op3_quality_rules": quality.oracle(),
        "op4_source_mix": mixing.oracle(),
        "op6_url_filter": url_filter.oracle(),
        "op8_warc_index": warc.oracle(),
        "op11_decontaminate": decontaminate.oracle(),
        "op12_filter_audit": filter_audit.oracle(),
        "op13_conversation_repair": conversation_repair.oracle(),
    }
