"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from basketflow.llm.decontaminate import OP7_SQL, op7_simhash_decontamination
from basketflow.llm.language import op6_ftrl_language
from basketflow.llm.licences import op9_minhash_licences
from basketflow.llm.main_text import op2_nearest_url_main_text
from basketflow.llm.merkle import OP13_SQL, op13_butterfly_manifest
from basketflow.llm.near_dedup import OP8_SQL, op8_minhash_near_dedup
from basketflow.llm.negatives import OP12_SQL, op12_residue_hard_negatives
from basketflow.llm.packing import op3_karmarkar_karp_packing
from basketflow.llm.pii import op1_bootstrapped_pii
from basketflow.llm.repeats import OP4_SQL, op4_column_bwt_repeats
from basketflow.llm.sharding import op10_feistel_shards
from basketflow.llm.token_files import op11_ranked_token_files
from basketflow.llm.vectors import OP5_SQL, op5_fagin_top_k

QUERIES = {
    "op7_simhash_decontamination": op7_simhash_decontamination,
    "op9_minhash_licences": op9_minhash_licences,
    "op2_nearest_url_main_text": op2_nearest_url_main_text,
    "op1_bootstrapped_pii": op1_bootstrapped_pii,
    "op4_column_bwt_repeats": op4_column_bwt_repeats,
    "op5_fagin_top_k": op5_fagin_top_k,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op6_ftrl_language": op6_ftrl_language,
    "op3_karmarkar_karp_packing": op3_karmarkar_karp_packing,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_ranked_token_files": op11_ranked_token_files,
    "op12_residue_hard_negatives": op12_residue_hard_negatives,
    "op13_butterfly_manifest": op13_butterfly_manifest,
}

ORACLE: dict[str, str] = {
    "op7_simhash_decontamination": OP7_SQL,
    "op4_column_bwt_repeats": OP4_SQL,
    "op5_fagin_top_k": OP5_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op12_residue_hard_negatives": OP12_SQL,
    "op13_butterfly_manifest": OP13_SQL,
}
