"""A training corpus from documents: quality rules, toxicity, near copies, mix, tokens.

Each stage reads what its predecessor wrote and returns a DataFrame; ``run`` writes each
to the shared folder and reads it again.

Defined results, stage by stage: quality rules reject null, empty and short texts, so no later
stage of ``run`` meets them, but each stage takes them if it is given them: toxicity scores them
by its bias, the Jaccard join keeps every row without words, the mix deals them as rows without
tokens, BPE gives them no ids. Ties and repeated rows: one row of a class of copies stays, that
with the least id (null ids last, then the least digest); the mix may repeat what stays. Null ids
and null sources are values like others; extra columns, whatever their names, pass through all
stages but the last, which returns ``doc_id`` and the digests. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import lsh_forest, mixing, quality_rules, toxicity, word_bpe
from millrace.workspace import table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("toxicity", toxicity.stage),
    ("jaccard_join", lsh_forest.stage),
    ("mixing", mixing.stage),
    ("bpe", word_bpe.stage),
]
#: The factorization machine and the token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
