"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .license_scan import op9_license_scan
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op6_best_fit_packing
from .quality import op10_quality_classifier
from .quality_rules import op4_quality_rules
from .simhash import op5_simhash_near_dedup
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op3_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
}
