"""The queries of the training-data operators, and their SQL where SQL can express them."""

from . import bpe, chroma, hmm_lm, merkle, minhash, mixing, packing, quality, rules, substring, toxicity, trie, warc

QUERIES = {
    "op1_toxicity_crf": toxicity.query,
    "op2_byte_bpe": bpe.query,
    "op3_quality_classifier": quality.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": rules.query,
    "op6_warc": warc.query,
    "op7_hmm_lm": hmm_lm.query,
    "op8_suffix_dedup": substring.query,
    "op9_minhash_near_dedup": minhash.query,
    "op10_chroma_fingerprints": chroma.query,
    "op11_prefix_trie": trie.query,
    "op12_mix_weights": mixing.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLES: dict[str, str] = {"op6_warc": warc.ORACLE, "op11_prefix_trie": trie.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
