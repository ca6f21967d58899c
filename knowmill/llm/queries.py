"""The registered queries of the training-data operators and their SQL."""

from . import conversations, jaccard, licenses, lines, lm, mixing, packing, pii, quality, spelling, topk, toxicity, urls

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_pii, jaccard.op2_ngram_jaccard, topk.op3_exact_topk, urls.op4_url_filters, packing.op5_packing,
        licenses.op6_license_scan, toxicity.op7_toxicity, lm.op8_lm_scoring, mixing.op9_mixing, quality.op10_quality_rules,
        conversations.op11_conversation_repair, spelling.op12_spelling_variants, lines.op13_line_dedup,
    )
}
ORACLE = {**topk.ORACLE, **lines.ORACLE}
