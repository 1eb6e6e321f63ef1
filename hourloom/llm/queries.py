"""The registered queries: each dealt operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from hourloom.llm import sql
from hourloom.llm.chat import op6_digest, round_trip, with_adversary
from hourloom.llm.codes import compress, op12_digest
from hourloom.llm.decontaminate import contamination, op1_digest
from hourloom.llm.infill import infill, op13_digest
from hourloom.llm.mixing import op9_digest, plan
from hourloom.llm.neardup import near_duplicates, op3_digest
from hourloom.llm.personal import find, op11_digest
from hourloom.llm.quality import score as quality_score
from hourloom.llm.repetition import measure
from hourloom.llm.secrets import op2_digest, scan
from hourloom.llm.sharding import assign, op8_digest
from hourloom.llm.token_records import read_digests, write_records
from hourloom.llm.toxicity import op7_digest
from hourloom.llm.toxicity import score as toxicity_score
from hourloom.session import configure

Runner = Callable[[SparkSession, str], DataFrame]

RUNNERS: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        RUNNERS[run.__name__] = lambda spark, sf_dir: run(configure(spark), sf_dir)
        if check is not None:
            SQL[run.__name__] = check
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(sql.OP1)
def op1_decontaminate(spark, sf_dir):
    return op1_digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query()
def op2_secrets(spark, sf_dir):
    return op2_digest(scan(table(spark, sf_dir, "documents")))


@query()
def op3_near_duplicates(spark, sf_dir):
    return op3_digest(near_duplicates(table(spark, sf_dir, "documents")))


@query()
def op4_token_records(spark, sf_dir):
    from public_tokenizers import path

    manifest = write_records(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), end_id=1, by_word=True)
    return read_digests(manifest)


@query()
def op5_repetition(spark, sf_dir):
    return measure(table(spark, sf_dir, "documents"))


@query(sql.OP6)
def op6_chat(spark, sf_dir):
    return op6_digest(round_trip(with_adversary(table(spark, sf_dir, "conversations"))))


@query()
def op7_toxicity(spark, sf_dir):
    return op7_digest(toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query()
def op8_sharding(spark, sf_dir):
    return op8_digest(assign(table(spark, sf_dir, "documents")))


@query()
def op9_mixing(spark, sf_dir):
    return op9_digest(plan(table(spark, sf_dir, "documents")))


@query()
def op10_quality(spark, sf_dir):
    return quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query()
def op11_personal(spark, sf_dir):
    return op11_digest(find(table(spark, sf_dir, "documents")))


@query(sql.OP12)
def op12_vector_codes(spark, sf_dir):
    return op12_digest(*compress(table(spark, sf_dir, "embeddings")))


@query(sql.OP13)
def op13_infill(spark, sf_dir):
    return op13_digest(infill(table(spark, sf_dir, "documents")))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
