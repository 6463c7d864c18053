"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeward.llm import (
    decontaminate, embeddings, grammar, language, periodic, pieces, pii, quality, secret_scan, sharding, simhash,
    suffixes, variants,
)
from lakeward.llm.common import table
from lakeward.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL where it can express an operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


@query("op1_embeddings")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    network = language.fit(docs.where(~language.held_out()))
    return language.identify(docs, network).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learn = ~quality.held_out()
    model = quality.fit(docs.where(learn), table(spark, folder, "labels").where(learn))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query("op4_simhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_suffixes")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query("op6_decontaminate")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_grammar")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    grammar.write(table(spark, folder, "documents"), path, grammar.tokenizer_definition())
    return grammar.read(spark, path)


@query("op8_pieces")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(pieces.vocabulary_path())
    out = pieces.encode(table(spark, folder, "documents"), vocabulary)
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "exact")


@query("op9_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, found_col="kinds")


@query("op11_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    planted = periodic.with_planted_runs(table(spark, folder, "documents"))
    return periodic.digests(periodic.find_runs(planted))


@query("op12_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    counts = variants.count_words(table(spark, folder, "documents"), change=variants.drop_letters)
    return variants.group_variants(counts)


@query("op13_secrets")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, folder, "documents")))
