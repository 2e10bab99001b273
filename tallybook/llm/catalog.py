"""The registered queries of the language-model operators, and the SQL where SQL can express one."""

from __future__ import annotations

from .byte_bpe import op10_byte_bpe
from .chat_format import OP12_SQL, op12_chat
from .decontaminate import op5_decontaminate
from .importance import OP11_SQL, op11_importance
from .jaccard_join import OP2_SQL, op2_jaccard_join
from .line_dedup import OP3_SQL, op3_line_dedup
from .merkle import OP13_SQL, op13_merkle
from .nearest import op6_nearest
from .pii import op7_pii
from .quality import op4_quality
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .toxicity import op9_toxicity
from .url_filters import OP8_SQL, op8_url_filters

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_nearest": op6_nearest,
    "op7_pii": op7_pii,
    "op8_url_filters": op8_url_filters,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_importance": op11_importance,
    "op12_chat": op12_chat,
    "op13_merkle": op13_merkle,
}
ORACLE = {
    "op1_substring_dedup": OP1_SQL,
    "op2_jaccard_join": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op8_url_filters": OP8_SQL,
    "op11_importance": OP11_SQL,
    "op12_chat": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
