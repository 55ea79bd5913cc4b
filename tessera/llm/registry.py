"""Queries of this subpackage and the SQL for those that SQL can express."""

from tessera.llm import (
    class_lm,
    decontamination,
    filter_audit,
    jaccard_join,
    mixing,
    phrase_mining,
    pii,
    quality_rules,
    secret_scan,
    substring_dedup,
    toxicity,
    url_filter,
    warc_archive,
)

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_warc": warc_archive.op6_warc,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_pii": pii.op10_pii,
    "op11_phrase_mining": phrase_mining.op11_phrase_mining,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_class_lm": class_lm.op13_class_lm,
}
ORACLE_SQL = {
    "op1_jaccard_join": jaccard_join.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op4_secret_scan": secret_scan.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_warc": warc_archive.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op11_phrase_mining": phrase_mining.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
