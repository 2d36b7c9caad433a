"""The queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_formatting
from .decontam import op2_benchmark_decontamination
from .htmltext import op9_html_extraction
from .langid import op7_language_id
from .linededup import OP4_SQL, op4_line_dedup
from .merkle import OP11_SQL, op11_merkle_dataset_manifest
from .packing import op3_best_fit_packing
from .periodic import OP13_SQL, op13_periodic_runs
from .quality import op12_quality_classifier
from .sharding import op8_sharding
from .simhash import op6_simhash_near_dedup
from .spotsigs import op5_document_fingerprints
from .toxicity import op10_toxicity

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_dataset_manifest": op11_merkle_dataset_manifest,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {"op1_chat_formatting": OP1_SQL, "op4_line_dedup": OP4_SQL, "op11_merkle_dataset_manifest": OP11_SQL, "op13_periodic_runs": OP13_SQL}
