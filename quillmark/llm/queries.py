"""Registry of the subpackage: queries and the SQL that DuckDB can check them with."""

from __future__ import annotations

from quillmark.llm import alignment, chat, decontaminate, html, language, lines, minhash, packing, quality, secrets, sharding, spelling, topk

QUERIES = {"op7_chat": chat.op7_chat, "op1_html": html.op1_html, "op8_quality": quality.op8_quality, "op5_lines": lines.op5_lines, "op4_decontaminate": decontaminate.op4_decontaminate, "op9_topk": topk.op9_topk, "op6_secrets": secrets.op6_secrets, "op2_minhash": minhash.op2_minhash, "op3_language_id": language.op3_language_id, "op10_packing": packing.op10_packing, "op11_spelling": spelling.op11_spelling, "op12_alignment": alignment.op12_alignment, "op13_sharding": sharding.op13_sharding}
ORACLES: dict[str, str] = {"op6_secrets": secrets.ORACLE, "op7_chat": chat.ORACLE, "op9_topk": topk.ORACLE, "op11_spelling": spelling.ORACLE}
