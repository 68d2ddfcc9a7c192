"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from kairoscope.llm import bpe, chat, embeddings, fingerprints, language, mixing, quality, repeats, runs, secrets, simhash, toxicity, trie

QUERIES = {
    "op1_embedding_dedup": embeddings.op1_embedding_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality": quality.op4_quality,
    "op5_bpe": bpe.op5_bpe,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat.op7_chat_format,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_repeated_bytes": repeats.op12_repeated_bytes,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_embedding_dedup": embeddings.OP1_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
