"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import audit, decontaminate, langid, licenses, minhash, mixing, mtree, negatives, sharding, substring, toxicity, urlrules, warc

QUERIES = {
    "op1_warc_archives": warc.query,
    "op2_language_id": langid.query,
    "op3_minhash_near_dedup": minhash.query,
    "op4_toxicity": toxicity.query,
    "op5_substring_dedup": substring.query,
    "op6_consistent_sharding": sharding.query,
    "op7_mixing_weights": mixing.query,
    "op8_exact_top_k": mtree.query,
    "op9_license_scan": licenses.query,
    "op10_decontaminate": decontaminate.query,
    "op11_url_rules": urlrules.query,
    "op12_filter_audit": audit.query,
    "op13_hard_negatives": negatives.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archives": warc.ORACLE_SQL,
    "op3_minhash_near_dedup": minhash.ORACLE_SQL,
    "op5_substring_dedup": substring.ORACLE_SQL,
    "op7_mixing_weights": mixing.ORACLE_SQL,
    "op8_exact_top_k": mtree.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op11_url_rules": urlrules.ORACLE_SQL,
    "op12_filter_audit": audit.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
