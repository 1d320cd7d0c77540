"""Queries of this package, by name; each takes (spark, data directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import articles, density, gaps, languages, sentences, token_budget
from skein.llm.mixing import mix_sources
from skein.llm.near_duplicates import all_pairs, groups, near_duplicates
from skein.llm.packing import pack
from skein.llm.repeated_lines import flag_repeated, without_repeated
from skein.llm.splitting import split_oversized
from skein.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_repeated(table(spark, d, "units"), table(spark, d, "pages")).where("repeated").select("source_id", "unit_idx")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated(table(spark, d, "units"), table(spark, d, "pages"))


def _tagger(spark: SparkSession, d: str) -> languages.Crf:
    return languages.learn(languages.sample_articles(table(spark, d, "articles")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pages, texts = spread(table(spark, d, "pages")), table(spark, d, "articles")
    residue = articles.judged(pages, texts, articles.fit(pages)).where("case").select("source_id", F.explode("residue").alias("unit_idx"))
    return languages.foreign_units(table(spark, d, "units"), texts, _tagger(spark, d), residue)


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    return languages.block_languages(table(spark, d, "units"), _tagger(spark, d), segments=True).drop("weights")


def p2_articles(spark: SparkSession, d: str) -> DataFrame:
    return languages.article_languages(languages.block_languages(table(spark, d, "units"), _tagger(spark, d)), table(spark, d, "articles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "pages"))
    return articles.judged(pages, table(spark, d, "articles"), articles.fit(pages)).where("case").select("source_id")


def p6_method(spark: SparkSession, d: str) -> DataFrame:
    return density.other_units(spread(table(spark, d, "pages")), table(spark, d, "articles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "pages"))
    rows = articles.judged(pages, table(spark, d, "articles"), articles.fit(pages))
    return rows.select("source_id", F.explode("other").alias("unit_idx"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    split = split_oversized(table(spark, d, "units"), table(spark, d, "chunkconfig"))
    return split.where("piece_idx = 0").select("config_id", "source_id", "unit_idx")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "units"), table(spark, d, "chunkconfig"))


def _slices(spark: SparkSession, d: str) -> DataFrame:
    blocks = languages.block_languages(table(spark, d, "units"), _tagger(spark, d))
    return token_budget.slices(table(spark, d, "pages"), languages.article_languages(blocks, table(spark, d, "articles")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.miscounted(table(spark, d, "units"))


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.merge_totals(table(spark, d, "units"), _slices(spark, d), token_budget.load_merges())


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.estimate_totals(table(spark, d, "units"), _slices(spark, d))


def _near_articles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = spread(table(spark, d, "pages"))
    bodies = articles.judged(pages, table(spark, d, "articles"), articles.fit(pages), with_body=True)
    return near_duplicates(bodies.where("not case").select(F.col("source_id").alias("id"), "body"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return all_pairs(*_near_articles(spark, d))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(*_near_articles(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose remainder shares a container: the packed last parts of texts that were cut."""
    packed = pack(spread(table(spark, d, "documents")), table(spark, d, "packconfig"))
    return packed.where("parts > 1 and part_idx = parts - 1 and container_id is not null").select("pack_id", "doc_id")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(spread(table(spark, d, "documents")), table(spark, d, "packconfig"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _, shares = mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mixtargets"))
    return shares.where(F.col("short")).select("mix_id", "source")


def p9_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mixtargets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mixtargets"))[1]


def p10_method(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents"))
    return gaps.gap_sentences(documents, gaps.learn_gaps(documents))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents"))
    return sentences.sentences(documents, sentences.learn_all(documents))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_clean, p2_found, p2_blocks, p2_articles, p3_found, p6_method, p6_found, p4_found, p4_pieces, p5_method, p5_found, p5_totals, p7_found, p7_groups, p8_found, p8_packed, p9_found, p9_chosen, p9_shares, p10_method, p10_found)
}
