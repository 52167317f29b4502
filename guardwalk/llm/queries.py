"""The subpackage's queries and their SQL."""

from __future__ import annotations

from guardwalk.llm import bpe, flac, licenses, mixing, neardup, ngramjoin, quality, secrets, sharding, trie, unigram, warc, whitening

QUERIES = {
    "op1_license_scans": licenses.query,
    "op2_media_flac": flac.query,
    "op3_warc_salvage": warc.query,
    "op4_token_counts": unigram.query,
    "op5_minhash_near_dedup": neardup.query,
    "op6_sharding": sharding.query,
    "op7_byte_bpe": bpe.query,
    "op8_secret_scans": secrets.query,
    "op9_mixing": mixing.query,
    "mixing_taken": mixing.taken_query,
    "op10_quality_rules": quality.query,
    "op11_whitening": whitening.query,
    "op12_prefix_trie": trie.query,
    "op13_ngram_join": ngramjoin.query,
}
ORACLES = {
    "op3_warc_salvage": warc.ORACLE,
    "op5_minhash_near_dedup": neardup.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op8_secret_scans": secrets.ORACLE,
    "mixing_taken": mixing.sql(),
    "op10_quality_rules": quality.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_ngram_join": ngramjoin.ORACLE,
}
