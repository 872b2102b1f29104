"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, collocation, decontaminate, idstore, maxent, mpegts, packing, periodic, pii, simhash, toxicity, warc

QUERIES = {
    "op1_lm_score": maxent.op1_lm_score,
    "op2_pii": pii.op2_pii,
    "op3_token_ids": idstore.op3_token_ids,
    "op4_warc": warc.op4_warc,
    "op5_simhash": simhash.op5_simhash,
    "op6_preference": chat.op6_preference,
    "op7_media": mpegts.op7_media,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_collocations": collocation.op12_collocations,
    "op13_bpe": bpe.op13_bpe,
}
ORACLES: dict[str, str] = {
    "op4_warc": warc.ORACLE,
    "op6_preference": chat.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op12_collocations": collocation.ORACLE,
}
