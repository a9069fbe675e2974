"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .brown import op6_brown_lm
from .decontaminate import OP1_SQL, op1_decontaminate
from .embedding_dedup import OP2_SQL, op2_embedding_dedup
from .line_dedup import op8_line_dedup
from .mixing import mixing_sql, op4_mixing
from .periodic import OP11_SQL, op11_periodic_runs
from .quality import op10_quality
from .roles import op3_role_repair, role_sql
from .secrets import op9_secrets
from .simhash import op7_simhash_dedup
from .structure import op13_structure_repair, structure_sql
from .token_counts import op12_token_counts
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_embedding_dedup,
        op3_role_repair,
        op4_mixing,
        op5_toxicity,
        op6_brown_lm,
        op7_simhash_dedup,
        op8_line_dedup,
        op9_secrets,
        op10_quality,
        op11_periodic_runs,
        op12_token_counts,
        op13_structure_repair,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op3_role_repair": role_sql(), "op4_mixing": mixing_sql(), "op11_periodic_runs": OP11_SQL, "op13_structure_repair": structure_sql()}
