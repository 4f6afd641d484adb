"""Queries and SQL of the corpus operators, for the entry file."""

from __future__ import annotations

import corpus_pipeline

from .clustering import OP11_SQL, op11_ns_bounds
from .decontaminate import op3_positional_index
from .embedding_dedup import OP12_SQL, op12_projection_passes
from .lexical import OP13_SQL, op13_ball_tree
from .lm_score import op9_log_bilinear
from .mixing import OP6_SQL, op6_pareto_mix
from .pii import op2_sanitise
from .quality import op8_risk_controlled
from .secrets import op5_decoding_worklist
from .simhash import op10_simhash
from .substring_dedup import op7_substring_dedup
from .toxicity import op4_subword_bag
from .url_filter import op1_link_trust


def queries() -> dict:
    ops = (op1_link_trust, op2_sanitise, op3_positional_index, op4_subword_bag, op5_decoding_worklist, op6_pareto_mix,
           op7_substring_dedup, op8_risk_controlled, op9_log_bilinear, op10_simhash,
           op11_ns_bounds, op12_projection_passes, op13_ball_tree)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    out = {"op6_pareto_mix": OP6_SQL, "op11_ns_bounds": OP11_SQL, "op12_projection_passes": OP12_SQL,
           "op13_ball_tree": OP13_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
