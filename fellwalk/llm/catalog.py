"""Queries of the corpus operators and, where SQL can say it, the SQL that checks them."""

from __future__ import annotations

from .centroid_clustering import OP13_SQL, op13_centroid_clustering
from .edit_fingerprints import op11_edit_fingerprints
from .embedding_dedup import OP10_SQL, op10_embedding_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .html_main import op2_html_extraction
from .language_id import op1_language_id
from .mixing import OP6_SQL, op6_mixing
from .ngram_lm import op8_lm_scoring
from .packing import op5_packing
from .quality_knn import op3_quality_classifier
from .quality_rules import op4_quality_rules
from .simhash import op7_simhash_dedup
from .substring_dedup import OP9_SQL, op9_substring_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_edit_fingerprints": op11_edit_fingerprints,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op10_embedding_dedup": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
