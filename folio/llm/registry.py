"""Queries of the training-data operators with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .bpe import op10_byte_bpe
from .chat import op3_chat_format
from .decontaminate import OP2_SQL, SHINGLES_SQL, op2_decontaminate
from .jaccard import op9_jaccard_join
from .linededup import OP7_SQL, op7_line_dedup
from .neardup import OP6_SQL, op6_embedding_near_dedup
from .quality import op5_quality_resampling
from .sharding import op1_sharding
from .tokenbin import op8_token_binary
from .toxicity import op4_toxicity

OP9_SQL = f"""
with recursive s as (select distinct id, s from ({SHINGLES_SQL.format(rows="(select doc_id as id, text from documents)")})),
n as (select id, count(*) as n from s group by id),
p as (select a.id as a, b.id as b, count(*) as c from s a join s b on a.s = b.s and a.id < b.id group by a.id, b.id),
l as (select a, b from p join n x on x.id = a join n y on y.id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as root from documents union select e.b, r.root from r join e on r.id = e.a)
select id as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(root) as component_id from r left join n using (id) group by id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_quality_resampling": op5_quality_resampling,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_binary": op8_token_binary,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_byte_bpe": op10_byte_bpe,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_jaccard_join": OP9_SQL,
}
