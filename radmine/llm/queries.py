"""The queries of the corpus operators, for the entry point."""

from __future__ import annotations

from . import chat, langid, lines, media, minhash, mixing, neighbours, pieces, tokens, warc

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_line_dedup": lines.op2,
    "op3_neighbours": neighbours.op3,
    "op4_token_counts": tokens.op4,
    "op5_minhash": minhash.op5,
    "op6_language_id": langid.op6,
    "op7_warc": warc.op7,
    "op8_media": media.op8,
    "op9_chat": chat.op9,
    "op10_sentencepiece": pieces.op10,
    "media_payloads": media.payloads,
}
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op3_neighbours": neighbours.OP3_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_chat": chat.OP9_SQL,
    "media_payloads": media.PAYLOAD_SQL,
}
