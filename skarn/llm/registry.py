"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from skarn.llm.align import op11_align
from skarn.llm.ann import op1_ann
from skarn.llm.chat import OP6_SQL, op6_chat
from skarn.llm.decontaminate import op5_decontaminate
from skarn.llm.langid import op2_langid
from skarn.llm.lm import op7_lm
from skarn.llm.names import op13_names
from skarn.llm.packing import op3_packing
from skarn.llm.pii import op8_pii
from skarn.llm.quality import op9_quality
from skarn.llm.simhash import op10_simhash
from skarn.llm.spots import op12_spots
from skarn.llm.suffix_dedup import op4_suffix_dedup

QUERIES = {
    "op1_ann": op1_ann,
    "op2_langid": op2_langid,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat": op6_chat,
    "op7_lm": op7_lm,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_align": op11_align,
    "op12_spots": op12_spots,
    "op13_names": op13_names,
}

ORACLES: dict[str, str] = {
    "op6_chat": OP6_SQL,
}
