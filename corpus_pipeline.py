"""A corpus pipeline of five stages over `documents`. Each stage's result is written and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import langid, mixing, ngram_join, packing, secrets
from waymark.llm.common import collected, erase, fresh, written
from waymark.llm.queries import vocabulary

#: A document whose best language holds a smaller share of its words is rejected, as is one without a language.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined; `und` ones (null texts are) and those without a leading language go."""
    found = fresh(docs, "found")["found"]
    labelled = langid.predicted(docs, langid.train(docs), found)
    return labelled.filter((F.col(found)["lang"] != langid.UNDETERMINED) & (F.col(found)["score"] >= LEAST_SHARE)).select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: that with the smallest doc_id. Texts without words stay."""
    return ngram_join.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what the scan finds in its text is masked."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a whole document for each pass over it, and the stretches of it that a begun pass takes."""
    return mixing.excerpts(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("language ID", language_id), ("n-gram Jaccard join", ngram_join_stage), ("secret scans", secret_scan), ("source mixing", source_mixing), ("best-fit packing", best_fit_packing)]
#: A learned field and a tokenizer are no SQL: tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with collected() as tables:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            # What the stage has written on its way, and what it read, is not read any more.
            for spent in tables[:-1]:
                erase(spent)
            del tables[:-1]
        return STAGES[-1][1](spark, docs, sf_dir)
