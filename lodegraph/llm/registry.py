"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from lodegraph.llm import decontam, fingerprints, licenses, linededup, pii, quality, simhash, substrings, subword, warc

QUERIES = {
    "op1_pii_bootstrap": pii.op1_pii_bootstrap,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_warc_archive": warc.op3_warc_archive,
    "op4_simhash_near_duplicates": simhash.op4_simhash_near_duplicates,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_sentencepiece": subword.op7_sentencepiece,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
}
ORACLES: dict[str, str] = {
    "op3_warc_archive": warc.OP3_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op9_substring_dedup": substrings.OP9_SQL,
}
