"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import op6_bpe
from .chat_format import OP1_SQL, op1_chat_format
from .decontamination import op8_decontamination
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .minhash import OP9_SQL, op9_minhash
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_rules import op3_quality_rules
from .secrets import op2_secrets
from .sharding import op10_sharding
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op4_token_counts
from .toxicity import op7_toxicity
from .url_filter import op12_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_secrets, op3_quality_rules, op4_token_counts, op5_suffix_dedup, op6_bpe, op7_toxicity, op8_decontamination, op9_minhash, op10_sharding, op11_prefix_trie, op12_url_filter, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op9_minhash": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
