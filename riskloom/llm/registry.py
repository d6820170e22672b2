"""The text queries and their SQL."""

from __future__ import annotations

from riskloom.llm import alignment, decontaminate, html_text, line_dedup, media, packing, pitman_yor, prefix_trie, quality, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_lm_score": pitman_yor.op7_lm_score,
    "op8_html_text": html_text.op8_html_text,
    "op9_quality": quality.op9_quality,
    "op10_packing": packing.op10_packing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_alignment": alignment.op12_alignment,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL = {"op3_url_filter": url_filter.OP3_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op5_warc": warc.OP5_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL}
