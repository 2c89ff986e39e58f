"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, html_text, jaccard, language, line_dedup, media, mixing, packing, quality, toxicity, url_filters, vector_codes, warc

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_media_columns": media.op5_media_columns,
    "op6_mixing_sources": mixing.op6_mixing_sources,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLE_SQL = {
    "op2_url_filters": url_filters.OP2_SQL,
    "op7_warc": warc.OP7_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
