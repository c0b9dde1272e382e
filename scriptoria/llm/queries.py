"""The queries of this subpackage and the SQL that must give the same rows.

Language ID and quality grades are trained models: held-out accuracy stands in for SQL.  Tokens have no SQL: a brute-force
version stands in for it.
"""

from __future__ import annotations

from scriptoria.llm.alignment import op13_tokenizer_alignment
from scriptoria.llm.centroids import OP11_SQL, op11_centroid_clustering
from scriptoria.llm.chat_format import OP5_SQL, op5_chat_format
from scriptoria.llm.decontaminate import OP3_SQL, op3_decontamination
from scriptoria.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from scriptoria.llm.langid import op4_language_id
from scriptoria.llm.minhash import OP7_SQL, op7_minhash_near_dedup
from scriptoria.llm.mixing import OP8_SQL, op8_mixing
from scriptoria.llm.quality import op9_quality_classifier
from scriptoria.llm.sharding import OP6_SQL, op6_sharding
from scriptoria.llm.spotsigs import OP12_SQL, op12_document_fingerprints
from scriptoria.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from scriptoria.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_sharding": op6_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL = {
    "op1_url_filter": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_sharding": OP6_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_document_fingerprints": OP12_SQL,
}
