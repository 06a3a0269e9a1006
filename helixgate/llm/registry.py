"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import base
from .decontaminate import op8_decontaminate
from .line_templates import op10_line_templates
from .lm_score import ORACLE as OP4_SQL
from .lm_score import op4_lm_scores
from .mixing import op7_mixing
from .pseudonyms import op9_pseudonyms
from .quality import op6_quality_rules
from .secrets import op3_secret_scan
from .simhash import op2_simhash
from .sstable import op5_token_shards
from .url_templates import op1_url_templates

QUERIES = {
    "op1_url_templates": op1_url_templates,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_lm_scores": op4_lm_scores,
    "op5_token_shards": op5_token_shards,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_decontaminate": op8_decontaminate,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_line_templates": op10_line_templates,
    **base.QUERIES,
}

ORACLES: dict[str, str] = {"op4_lm_scores": OP4_SQL, **base.ORACLES}
