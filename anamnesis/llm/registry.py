"""All queries of this package and the SQL that some of them have."""

from __future__ import annotations

from anamnesis.llm.q_alignment import op11_tokenizer_alignment
from anamnesis.llm.q_bpe import op2_bpe_round_trip
from anamnesis.llm.q_extraction import op5_main_text
from anamnesis.llm.q_hnsw import ORACLE as NEIGHBOURS_SQL
from anamnesis.llm.q_hnsw import op10_hnsw_neighbours
from anamnesis.llm.q_jaccard import ORACLE as JACCARD_SQL
from anamnesis.llm.q_jaccard import op8_ngram_jaccard
from anamnesis.llm.q_langid import op7_language_id
from anamnesis.llm.q_media import op3_media_fingerprints
from anamnesis.llm.q_packing import op4_best_fit_packing
from anamnesis.llm.q_pii import op1_pii_pseudonyms
from anamnesis.llm.q_retrieval_packing import op12_retrieval_packing
from anamnesis.llm.q_secrets import op6_secret_scan
from anamnesis.llm.q_sharding import ORACLE as SHARDS_SQL
from anamnesis.llm.q_sharding import op9_lpt_shards

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms,
        op2_bpe_round_trip,
        op3_media_fingerprints,
        op4_best_fit_packing,
        op5_main_text,
        op6_secret_scan,
        op7_language_id,
        op8_ngram_jaccard,
        op9_lpt_shards,
        op10_hnsw_neighbours,
        op11_tokenizer_alignment,
        op12_retrieval_packing,
    )
}
ORACLES: dict[str, str] = {"op8_ngram_jaccard": JACCARD_SQL, "op9_lpt_shards": SHARDS_SQL, "op10_hnsw_neighbours": NEIGHBOURS_SQL}
