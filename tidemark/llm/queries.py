"""The subpackage's queries: the ten operators over their whole tables."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_format
from .flac import op6_flac_media
from .jaccard import op5_jaccard_join
from .mixing import OP1_SQL, op1_pareto_mix
from .packing import op10_pack
from .repetition import op3_quality_rules
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op9_token_counts
from .token_files import op8_token_files
from .url_rules import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_flac_media": op6_flac_media,
    "op7_url_filter": op7_url_filter,
    "op8_token_files": op8_token_files,
    "op9_token_counts": op9_token_counts,
    "op10_pack": op10_pack,
}
#: Where SQL over the tables can express a query. The others are tested against brute force.
ORACLES = {"op1_pareto_mix": OP1_SQL, "op2_chat_format": OP2_SQL, "op7_url_filter": OP7_SQL}
