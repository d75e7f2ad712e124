"""A corpus pipeline of five stages, each by one operator; counted as part of ``tessera.llm``.

Each stage works on all that its predecessor kept, and its decisions take effect: documents of low quality, all
but one of each class of near duplicates, and contaminated documents go; secrets are replaced in the texts; what is left is packed.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.op02_set_relation_join import keep_one
from tessera.llm.op03_vector_packing import pack_documents
from tessera.llm.op06_secret_ledger import remove_secrets
from tessera.llm.op07_nbsvm_quality import keep_good
from tessera.llm.op09_winnowing import remove_contaminated
from tessera.llm.scratch import Scratch, table
from tessera.sources.shipping import shipped

STAGES = [
    ("quality_classifier", shipped(keep_good)),
    ("ngram_jaccard_join", shipped(keep_one)),
    ("benchmark_decontamination", shipped(remove_contaminated)),
    ("secret_scans", shipped(remove_secrets)),
    ("best_fit_packing", shipped(pack_documents)),
]

#: The classifier and the tokenizer have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as s:
        for k, (name, stage) in enumerate(STAGES):
            docs = s.table(stage(spark, docs, sf_dir), name, keep=k == len(STAGES) - 1)
            if k:
                s.drop(STAGES[k - 1][0])
    return docs
