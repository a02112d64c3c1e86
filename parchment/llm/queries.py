"""The queries of this subpackage, and their SQL where SQL can tell the rows."""

from __future__ import annotations

from . import balls, chat, decontamination, grouping, packing, quality, simhash, substrings, suffix_tree, topk, toxicity, turns, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_suffix_tree": suffix_tree.op2,
    "op3_chat": chat.op3,
    "op4_simhash": simhash.op4,
    "op5_topk": topk.op5,
    "op6_substrings": substrings.op6,
    "op7_quality": quality.op7,
    "op8_packing": packing.op8,
    "op9_decontamination": decontamination.op9,
    "op10_warc": warc.op10,
    "op11_grouping": grouping.op11,
    "op12_turns": turns.op12,
    "op13_balls": balls.op13,
}

ORACLE_SQL = {
    "op3_chat": chat.OP3_SQL,
    "op5_topk": topk.OP5_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_turns": turns.OP12_SQL,
    "op13_balls": balls.OP13_SQL,
}
