"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import bpe, decontaminate, embedding_dedup, html_text, maxent_lm, oracles, periodic_runs, pii, prefix_forest, quality, ranked_search, simhash, substring_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxent_lm": maxent_lm.op1_maxent_lm,
    "op2_html_text": html_text.op2_html_text,
    "op3_pii": pii.op3_pii,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_prefix_forest": prefix_forest.op12_prefix_forest,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

# The other queries carry what a trained model gives, or hashes that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op6_decontaminate": oracles.DECONTAMINATE,
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op11_ranked_search": oracles.RANKED_SEARCH,
    "op12_prefix_forest": oracles.PREFIX_FOREST,
    "op13_periodic_runs": oracles.PERIODIC_RUNS,
}
