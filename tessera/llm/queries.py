"""The queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from tessera.llm import bpe, chat, codes, collocations, fingerprints, langid, minhash, mixing, pii, substring, tokenfiles, topk, warc

QUERIES = {
    "op1_mix": mixing.query,
    "op2_bpe": bpe.query,
    "op3_chat": chat.query,
    "op4_minhash": minhash.query,
    "op5_fingerprints": fingerprints.query,
    "op6_topk": topk.query,
    "op7_pii": pii.query,
    "op8_substring": substring.query,
    "op9_langid": langid.query,
    "op10_warc": warc.query,
    "op11_tokens": tokenfiles.query,
    "op12_collocations": collocations.query,
    "op13_codes": codes.query,
}

ORACLES = {
    "op1_mix": mixing.SQL,
    "op6_topk": topk.SQL,
    "op10_warc": warc.SQL,
    "op12_collocations": collocations.SQL,
    "op13_codes": codes.SQL,
}
