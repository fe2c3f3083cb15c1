"""Registered queries of the subpackage, by name, and the DuckDB SQL of those that SQL can express.

No SQL is given for the others: learned models (op4, op8, op9, op12), tokenizers (op2, op13), searches that SQL over whole
tables is too slow for (op1, op3), heuristics (op5) and rendering (op7). tests/llm/ holds
those against brute force, round trips or held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable

from spanweave.llm.alignment import op13_token_alignment
from spanweave.llm.decontamination import op1_decontaminate
from spanweave.llm.html_text import op7_html_text
from spanweave.llm.language_id import op4_language_id
from spanweave.llm.lexical import OP11_SQL, op11_ranked_search
from spanweave.llm.licences import op5_licence_scan
from spanweave.llm.lm_scoring import op8_lm_score
from spanweave.llm.near_dedup import op3_minhash_near_dedup
from spanweave.llm.packing import op2_best_fit_packing
from spanweave.llm.pii import op9_personal_data
from spanweave.llm.secret_scan import op12_secret_scan
from spanweave.llm.topk import OP10_SQL, op10_exact_topk
from spanweave.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_licence_scan": op5_licence_scan,
    "op6_warc": op6_warc,
    "op7_html_text": op7_html_text,
    "op8_lm_score": op8_lm_score,
    "op9_personal_data": op9_personal_data,
    "op10_exact_topk": op10_exact_topk,
    "op11_ranked_search": op11_ranked_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE: dict[str, str] = {
    "op6_warc": OP6_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
}
