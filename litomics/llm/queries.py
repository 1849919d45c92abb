"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import content_sort, turns, yinyang
from .content_sort import op13_content_sort
from .minhash import op8_circulant_minhash
from .packing import op7_grouped_packing
from .pii import op5_bilstm_crf_pii
from .quality import op2_isolation_rules
from .secrets import op9_entropy_secrets
from .sharding import op6_virtual_slots
from .templates import op3_template_decontamination
from .toxicity import op4_viterbi_toxicity
from .substrings import op1_suffix_automata
from .turns import op12_turn_layers
from .url_filter import op10_bloom_cascade
from .yinyang import op11_yinyang_lloyd

QUERIES = {f.__name__: f for f in (
        op1_suffix_automata, op2_isolation_rules, op3_template_decontamination, op4_viterbi_toxicity, op5_bilstm_crf_pii, op6_virtual_slots, op7_grouped_packing, op8_circulant_minhash, op9_entropy_secrets, op10_bloom_cascade,
        op11_yinyang_lloyd, op12_turn_layers, op13_content_sort,
    )}

ORACLES: dict[str, str] = {"op11_yinyang_lloyd": yinyang.oracle(), "op12_turn_layers": turns.oracle(), "op13_content_sort": content_sort.ORACLE}
