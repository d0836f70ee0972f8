"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, binary, brown, language, lines, media, near, packing, pieces, quality, ranked, sharding, suffix
from .common import read_table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(read_table(spark, sf_dir, "documents"), window=200)


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.train_and_score(read_table(spark, sf_dir, "documents"))


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(read_table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"), shards=8)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.write_and_check(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix, op2_brown, op3_near, op4_lines, op5_packing, op6_pieces, op7_sharding, op8_media, op9_quality, op10_binary, op11_ranked, op12_alignment, op13_language)}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op11_ranked": f"""with t as (select doc_id, unnest({_TERMS}) as term from documents), size as (select doc_id, count(*) as n from t group by doc_id),
      c as (select count(*) as nd, cast(sum(n) as bigint) as l from size), tf as (select doc_id, term, count(*) as tf from t group by all),
      w as (select term, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1))) as bigint) as w from tf, c group by term, nd),
      q as (select item_id, term, count(*) as k from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
      s as (select item_id, doc_id, cast(sum(k * w * (1000000000 * tf // (1000 * tf + 8 * (25 + 75 * n * nd // l)))) as bigint) as score
        from q join tf using (term) join w using (term) join size using (doc_id), c group by item_id, doc_id),
      r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0)
      select * from r where rank <= 10""",
}
