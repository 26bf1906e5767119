"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``posada.llm``.

Every stage is written as Parquet and read again as the next one's documents. The stages: quality classifier
(rejected documents go), n-gram Jaccard join (one document of each group stays), benchmark decontamination
(contaminated stretches go), personal data (spans are masked), BPE encoding (tokens of what is left).

What a stage gives for odd rows: a null or empty text has the classifier's bias as its score, is in no group, has
nothing to cut or to mask, and no tokens; a text that is cut to nothing stays as an empty one. Rows without an id stay
in every stage, each for itself. Of repeated rows the near-duplicate stage keeps one; ties there go to the least id,
then to the least hash of the text. Texts of any length are worked on whole. An empty table gives an empty one. Columns
of the documents other than id and text pass through all stages but the last, whatever their names.

``run`` writes to the folder in spark.checkpoint.dir, or to a temporary one where that is unset, as in tests; what
it writes goes when the session ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from posada.llm import bpe, decontaminate, jaccard_join, pii, quality
from posada.llm.components import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"), threshold=0.5)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, k=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"), max_words=0, max_coverage=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: SQL can't express the learned stages and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
