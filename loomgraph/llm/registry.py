"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import additive_ann, byte_bpe, decontaminate, fill_in_middle, language_id, license_scan, maxent_lm, pii, preference_format, simhash, spelling, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_preference_format": preference_format.op3_preference_format,
    "op4_additive_ann": additive_ann.op4_additive_ann,
    "op5_simhash": simhash.op5_simhash,
    "op6_maxent_lm": maxent_lm.op6_maxent_lm,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_pii": pii.op9_pii,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_language_id": language_id.op13_language_id,
}
ORACLES = {
    "op2_license_scan": license_scan.OP2_SQL,
    "op3_preference_format": preference_format.OP3_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
}
