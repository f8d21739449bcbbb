"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from casemill.llm import bytes_bpe, debruijn, lattice, lempel_ziv, mixing, norm_buckets, prefix_trie, quality, secrets, token_counts, toxicity, trie, vectors

QUERIES = {f.__name__: f for f in (secrets.op1_secret_scan, trie.op2_simhash_trie, lattice.op3_lattice_likelihood, toxicity.op4_ordinal_toxicity, quality.op5_random_indexing_quality, bytes_bpe.op6_byte_bpe, lempel_ziv.op7_lempel_ziv, mixing.op8_poisson_mix, token_counts.op9_rank_merge_counts, vectors.op10_histogram_topk, prefix_trie.op11_prefix_trie, norm_buckets.op12_norm_buckets, debruijn.op13_debruijn_dedup)}
ORACLE_SQL = {"op8_poisson_mix": mixing.OP8_SQL, "op10_histogram_topk": vectors.OP10_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op12_norm_buckets": norm_buckets.OP12_SQL, "op13_debruijn_dedup": debruijn.OP13_SQL}
