"""The operators' queries, and SQL for those that it can express."""

from . import chat, fingerprint, language, mixing, packing, quality, simhash, topk, url_filter, warc

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_chat_formatting": chat.query,
    "op3_language_id": language.query,
    "op4_url_filters": url_filter.query,
    "op5_source_mixing": mixing.query,
    "op6_document_fingerprints": fingerprint.query,
    "op7_exact_top_k": topk.query,
    "op8_warc_fixity": warc.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_quality_classifier": quality.query,
}
ORACLES: dict[str, str] = {"op7_exact_top_k": topk.ORACLE, "op8_warc_fixity": warc.ORACLE}
