"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pairwright.llm.licenses import op2_license_scan
from pairwright.llm.linededup import ORACLE_SQL as LINE_DEDUP_SQL
from pairwright.llm.linededup import op10_line_dedup
from pairwright.llm.merkle import op13_merkle_manifest
from pairwright.llm.ngramjoin import ORACLE_SQL as NGRAM_JOIN_SQL
from pairwright.llm.ngramjoin import op4_ngram_jaccard_join
from pairwright.llm.packing import op7_best_fit_packing
from pairwright.llm.periodic import op11_periodic_runs
from pairwright.llm.pii import op1_pii
from pairwright.llm.quality import op9_quality_classifier
from pairwright.llm.store import op5_content_store
from pairwright.llm.trie_bpe import op6_trie_bpe
from pairwright.llm.vectors import op8_embedding_neardup
from pairwright.llm.webp import op12_webp_media
from pairwright.llm.winnowing import op3_winnowing

QUERIES = {
    "op1_pii": op1_pii,
    "op2_license_scan": op2_license_scan,
    "op3_winnowing": op3_winnowing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_content_store": op5_content_store,
    "op6_trie_bpe": op6_trie_bpe,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_embedding_neardup": op8_embedding_neardup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_webp_media": op12_webp_media,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The other operators tokenize, compress, hash windows or iterate, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": NGRAM_JOIN_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL,
}
