"""The subpackage's queries and the SQL that checks those SQL can express."""

from __future__ import annotations

from . import alignment, chat, codebooks, decontaminate, language, linededup, packing, parityjoin, pieces, quality, rules, sharding, suffixdedup

QUERIES = {
    "op1_line_dedup": linededup.query,
    "op2_chat_formatting": chat.query,
    "op3_quality_classifier": quality.query,
    "op4_sharding": sharding.query,
    "op5_quality_rules": rules.query,
    "op6_suffix_dedup": suffixdedup.query,
    "op7_language_id": language.query,
    "op8_decontamination": decontaminate.query,
    "op9_sentencepiece": pieces.query,
    "op10_ngram_jaccard": parityjoin.query,
    "op11_best_fit_packing": packing.query,
    "op12_vector_codes": codebooks.query,
    "op13_tokenizer_alignment": alignment.query,
}
ORACLES = {
    "op1_line_dedup": linededup.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op10_ngram_jaccard": parityjoin.ORACLE,
    "op12_vector_codes": codebooks.ORACLE,
}
