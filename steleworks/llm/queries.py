"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import langid, logbilinear, maintext, matroska, maxscore, packing, simhash, suffixes, surrogates, unigram

QUERIES = {
    "op1_matroska": matroska.op1_matroska,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_unigram": unigram.op3_unigram,
    "op4_language_id": langid.op4_language_id,
    "op5_simhash": simhash.op5_simhash,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_main_text": maintext.op7_main_text,
    "op8_maxscore": maxscore.op8_maxscore,
    "op9_packing": packing.op9_packing,
    "op10_lm_scoring": logbilinear.op10_lm_scoring,
}

ORACLES: dict[str, str] = {"op8_maxscore": maxscore.OP8_SQL}
