"""The registered queries of the numbered operators, each over its whole table."""

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, boilerplate, decontaminate, language, lines, pieces, prefix_trie, quality, repeats, rules, simhash, toxicity, wordpiece
from .common import documents, fold, in_fold, labels

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(documents(spark, sf_dir), pieces.read_model(PIECE_MODEL)))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.dedup_lines(documents(spark, sf_dir)))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(documents(spark, sf_dir)))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean_lines(documents(spark, sf_dir)).drop("text")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.learn(docs.filter(fold(5) != 0))
    found = language.identify(docs, model)
    return found.select("doc_id", in_fold(5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    model = quality.learn(docs, marks.filter(fold(5) != 0).select("doc_id", F.col("quality").alias("label")))
    found = quality.score(docs, model)
    return found.select(
        "doc_id", in_fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model | None:
    marks = labels(spark, sf_dir).filter(fold(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.learn(docs, marks)


TOXIC_FROM = 0.7


def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return found.select(
        "doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    vocabulary = [
        sp.id_to_piece(i) for i in range(sp.vocab_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
    ]
    return wordpiece.count_tokens(documents(spark, sf_dir), *wordpiece.marked_vocabulary(vocabulary))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.shown(simhash.near_duplicates(documents(spark, sf_dir)), "component")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(documents(spark, sf_dir), benchmark)


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a_json, b_model = (pieces.read_model(p) for p in (BYTE_TOKENIZER, PIECE_MODEL))
    return alignment.align(documents(spark, sf_dir), a_json.decode(), b_model)[0]


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_sentencepiece": sentencepiece_round_trip,
    "op2_line_dedup": line_dedup,
    "op3_suffix_array_dedup": suffix_array_dedup,
    "op4_quality_rules": quality_rules,
    "op5_language_id": language_id,
    "op6_quality_classifier": quality_classifier,
    "op7_toxicity": toxicity_score,
    "op8_token_counts": token_counts,
    "op9_simhash_near_dedup": simhash_near_dedup,
    "op10_benchmark_decontamination": benchmark_decontamination,
    "op11_html_extraction": html_extraction,
    "op12_cross_tokenizer": cross_tokenizer,
    "op13_prefix_trie": conversation_trie,
}
ORACLES = {"op2_line_dedup": lines.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
