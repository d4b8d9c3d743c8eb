"""The operators' queries, with production parameters over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, embeddings, langid, lm, minhash, secrets, substring, warc

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_minhash": minhash.op3_minhash,
    "op4_lm_score": lm.op4_lm_score,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_chat_format": chat.op6_chat_format,
    "op7_language_id": langid.op7_language_id,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_warc_revisit": warc.op9_warc_revisit,
    "op10_embedding_dedup": embeddings.op10_embedding_dedup,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring.OP2_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_warc_revisit": warc.OP9_SQL,
}
