"""The queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from florascan.llm import cotraining, cover_codes, dom_model, fingerprints, line_crf, metric_tree, mixing, packing, range_search, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_canonical_digest": fingerprints.op2_canonical_digest,
    "op3_cotraining_quality": cotraining.op3_cotraining_quality,
    "op4_quality_lines": line_crf.op4_quality_lines,
    "op5_dom_model": dom_model.op5_dom_model,
    "op6_mixture_packing": packing.op6_mixture_packing,
    "op7_toxicity_neighbours": toxicity.op7_toxicity_neighbours,
    "op8_warc_normaliser": warc.op8_warc_normaliser,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_cover_codes": cover_codes.op11_cover_codes,
    "op12_range_search": range_search.op12_range_search,
    "op13_metric_search": metric_tree.op13_metric_search,
}

SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op8_warc_normaliser": warc.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_cover_codes": cover_codes.OP11_SQL,
    "op12_range_search": range_search.OP12_SQL,
    "op13_metric_search": metric_tree.OP13_SQL,
}
