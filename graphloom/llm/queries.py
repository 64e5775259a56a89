"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, hnsw, mixing, ngram, quality, repeats, secrets, simhash, syncmers, warc

QUERIES = {"op1_repeated_windows": repeats.op1_repeated_windows, "op8_trie_scores": ngram.op8_trie_scores, "op6_embedding_near_dedup": hnsw.op6_embedding_near_dedup, "op3_syncmer_prints": syncmers.op3_syncmer_prints, "op4_quality_fm": quality.op4_quality_fm, "op7_byte_bpe": bpe.op7_byte_bpe, "op5_warc_revisits": warc.op5_warc_revisits, "op2_secret_scan": secrets.op2_secret_scan, "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup, "op10_curriculum_mix": mixing.op10_curriculum_mix}
SQL = {"op5_warc_revisits": warc.OP5_SQL, "op10_curriculum_mix": mixing.OP10_SQL}
