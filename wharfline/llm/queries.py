"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, fixity, lm_score, manifest, ngram_join, packing, periodic_runs, repeats, secret_scan, token_counts, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_warc_fixity": fixity.op5_warc_fixity,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_chat_format": chat_format.op7_chat_format,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op8_packing": packing.op8_packing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_suffix_dedup": repeats.op11_suffix_dedup,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op5_warc_fixity": fixity.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op11_suffix_dedup": repeats.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
