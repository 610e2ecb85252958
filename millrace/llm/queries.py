"""The registered queries of this subpackage, and their SQL twins."""

from __future__ import annotations

from millrace.llm import lsh_forest, metric_join, mixing, ppm, quality_rules, site_style, token_counts, toxicity, url_filter, word_bpe

QUERIES = {
    "op1_html": site_style.op1_html,
    "op2_metric_join": metric_join.op2_metric_join,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_jaccard_join": lsh_forest.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_bpe": word_bpe.op8_bpe,
    "op9_ppm": ppm.op9_ppm,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
}
