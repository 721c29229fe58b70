"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from .ann_graph import op6_ann_graph
from .byte_bpe import op10_byte_bpe
from .decontaminate import op3_decontaminate
from .host_rules import OP12_SQL, op12_host_rules
from .licence_scan import op4_licence_scan, op4_sql
from .near_dedup import op8_near_dedup
from .resample import OP13_SQL, op13_resample
from .secret_scan import OP2_SQL, op2_secret_scan
from .shard_table import op7_shard_table, op7_sql
from .source_audit import OP11_SQL, op11_source_audit
from .token_counts import op5_token_counts
from .token_files import op1_token_files
from .toxicity import op9_toxicity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_licence_scan": op4_licence_scan,
    "op5_token_counts": op5_token_counts,
    "op6_ann_graph": op6_ann_graph,
    "op7_shard_table": op7_shard_table,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_source_audit": op11_source_audit,
    "op12_host_rules": op12_host_rules,
    "op13_resample": op13_resample,
}


def oracle_sql() -> dict[str, str]:
    return {"op4_licence_scan": op4_sql(), "op7_shard_table": op7_sql(), "op2_secret_scan": OP2_SQL, "op11_source_audit": OP11_SQL, "op12_host_rules": OP12_SQL, "op13_resample": OP13_SQL}
