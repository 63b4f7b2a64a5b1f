"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import ann, bpe, classifier, hmm, minhash, packing, quality, sharding, suffixes, warc

QUERIES = {
    "op1_hmm": hmm.op1_hmm,
    "op2_minhash": minhash.op2_minhash,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_sharding": sharding.op5_sharding,
    "op6_classifier": classifier.op6_classifier,
    "op7_bpe": bpe.op7_bpe,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_warc": warc.op9_warc,
    "op10_ann": ann.op10_ann,
}

ORACLE: dict[str, str] = {"op5_sharding": sharding.ORACLE, "op8_suffixes": suffixes.ORACLE}
