"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from quillspark.llm import decontamination, divergence, html, language, mixing, pii, quality, secrets, simhash, substrings, topk, toxicity, trie

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_pii": pii.op3_pii,
    "op4_html": html.op4_html,
    "op5_simhash": simhash.op5_simhash,
    "op6_substrings": substrings.op6_substrings,
    "op7_language": language.op7_language,
    "op8_mixing": mixing.op8_mixing,
    "op9_topk": topk.op9_topk,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_divergence": divergence.op11_divergence,
    "op12_quality": quality.op12_quality,
    "op13_trie": trie.op13_trie,
}
ORACLES = {"op2_decontamination": decontamination.SQL, "op8_mixing": mixing.SQL, "op9_topk": topk.SQL, "op11_divergence": divergence.SQL, "op12_quality": quality.SQL, "op13_trie": trie.SQL}
