"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from orderloom.llm.decontam import OP9_SQL, op9_decontaminate
from orderloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from orderloom.llm.licences import op6_license_scan
from orderloom.llm.mixing import op3_mix_sources
from orderloom.llm.neardup import OP10_SQL, op10_near_dedup
from orderloom.llm.quality import op5_quality_classifier
from orderloom.llm.runs import OP12_SQL, op12_periodic_runs
from orderloom.llm.simhash import op13_simhash_dedup
from orderloom.llm.substring import OP7_SQL, op7_substring_dedup
from orderloom.llm.suffix import OP2_SQL, op2_suffix_dedup
from orderloom.llm.tokens import op8_token_output
from orderloom.llm.toxicity import op1_toxicity
from orderloom.llm.trie import OP11_SQL, op11_prefix_trie

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_output": op8_token_output,
    "op9_decontaminate": op9_decontaminate,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash_dedup": op13_simhash_dedup,
}

ORACLE_SQL = {"op2_suffix_dedup": OP2_SQL, "op10_near_dedup": OP10_SQL, "op4_exact_dedup": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op9_decontaminate": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_periodic_runs": OP12_SQL}
