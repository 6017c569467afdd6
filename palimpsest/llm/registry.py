"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import curves, decontam, langid, lines, mixing, simhash, substrings, toxicity, urls, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_nearest_vectors": curves.op2_nearest_vectors,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": langid.op5_language_id,
    "op6_url_filter": urls.op6_url_filter,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_warc": warc.op9_warc,
    "op10_decontaminate": decontam.op10_decontaminate,
}

SQL = {
    "op1_mix_sources": mixing.SQL,
    "op6_url_filter": urls.SQL,
    "op9_warc": warc.SQL,
}
