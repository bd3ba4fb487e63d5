"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat
from .decontaminate import op5_decontaminate
from .language_id import op6_language_id
from .packing import op9_packing
from .pii import op2_pii
from .quality import op8_quality
from .secrets import op4_secrets
from .simhash import op10_simhash_dedup
from .substring_dedup import op1_substring_dedup
from .topk import OP7_SQL, op7_topk

QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_pii, op3_chat, op4_secrets, op5_decontaminate, op6_language_id, op7_topk, op8_quality, op9_packing, op10_simhash_dedup)
}

ORACLE_SQL = {"op3_chat": OP3_SQL, "op7_topk": OP7_SQL}
