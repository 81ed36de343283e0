"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm.decontaminate import op6_decontaminate
from tidemark.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from tidemark.llm.jaccard_join import op5_jaccard_join
from tidemark.llm.language_id import op4_language_id
from tidemark.llm.piece_codec import op10_sentencepiece
from tidemark.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from tidemark.llm.quality import op7_quality
from tidemark.llm.substring_dedup import op1_substring_dedup
from tidemark.llm.suffix_dedup import op9_suffix_dedup
from tidemark.llm.token_rollup import OP3_SQL, op3_token_rollup
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.vector_search import op2_vector_search
from tidemark.llm.warc_archive import OP12_SQL, op12_warc_archive

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_vector_search": op2_vector_search,
    "op3_token_rollup": op3_token_rollup,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc_archive": op12_warc_archive,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {"op3_token_rollup": OP3_SQL, "op11_fill_in_middle": OP11_SQL, "op12_warc_archive": OP12_SQL, "op13_prefix_trie": OP13_SQL}
