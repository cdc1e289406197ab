"""Verification of dictionary terms against the national standard-term lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import values, words
from hydromelt.operators.matching import contained_in
from hydromelt.operators.nearest import nearest
from hydromelt.operators.numbering import top_per


def verification_targets(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("standard_basis").contains(C.UNVERIFIED_BASIS))


def official_synonyms(standard: DataFrame) -> DataFrame:
    """Spelling -> official name from comma lists; the first official name wins."""
    each = standard.select("row_no", values.strip(F.col("term_name")).alias("official"),
                           F.posexplode(F.split(F.coalesce("synonyms", F.lit("")), ",")).alias("pos", "text"))
    return (each.withColumn("spelling", values.strip(F.col("text"))).where("spelling <> ''")
            .groupBy("spelling").agg(F.min_by("official", F.struct("row_no", "pos")).alias("official")))


def containing_terms(targets: DataFrame, standard: DataFrame) -> DataFrame:
    """All official names inside a target or around it, each once.

    ``targets``: term. Both directions are equi-joins on the shorter text's rarest run of letters.
    """
    terms = targets.select("term").distinct()
    official = standard.select(values.strip(F.col("term_name")).alias("official")).where("official <> ''").distinct()
    inside = contained_in(official, "official", terms, "term")
    around = contained_in(terms, "term", official, "official")
    return inside.select("term", "official").unionByName(around.select("term", "official")).where("term <> official")


def word_list(raw_words: DataFrame) -> DataFrame:
    """Usable standard words: blank and dropped ones left out; the last entry of a word wins."""
    part = raw_words.withColumn("word", values.strip(F.col("word"))).where("word <> ''")
    if "revision" in part.columns:
        part = part.where(F.coalesce(values.strip(F.col("revision")), F.lit("")) != C.DROPPED_WORD_REVISION)
    return part.groupBy("word").agg(F.max_by(F.coalesce(values.strip(F.col("abbr")), F.lit("")), "row_no").alias("abbr"))


def _segment(batch: pd.DataFrame) -> pd.DataFrame:
    parts = [words.decompose(term, set(vocabulary), max(map(len, vocabulary), default=0))
             for term, vocabulary in zip(batch["term"], batch["vocabulary"])]
    return batch.assign(parts=parts)[["term", "parts"]]


def segment_terms(targets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Full decomposition of each term into standard words; null when impossible.

    Each term meets only the words that occur in it, so the word list is never shipped whole.
    """
    terms = targets.select("term").distinct()
    usable = contained_in(vocabulary.select("word").distinct(), "word", terms, "term").groupBy("term").agg(
        F.collect_list("word").alias("vocabulary"))  # no more than a term has substrings
    full = terms.join(usable, "term", "left").withColumn(
        "vocabulary", F.coalesce("vocabulary", F.array().cast("array<string>")))
    return full.mapInPandas(lambda batches: (_segment(b) for b in batches), "term string, parts array<string>")


def verify_terms(targets: DataFrame, standard: DataFrame, vocabulary: DataFrame | None = None, *, related: int) -> DataFrame:
    """Verdict per target: listed, listed as synonym, composed of words, or not found.

    ``related``: how many of the names in :func:`containing_terms` are shown, the longest first.
    """
    terms = targets.select("code", values.strip(F.col("std_name")).alias("term"))
    listed = standard.select(values.strip(F.col("term_name")).alias("term")).distinct().withColumn(
        "listed", F.lit(True))
    spelled = official_synonyms(standard).withColumnRenamed("spelling", "term")
    nearest = top_per(containing_terms(terms, standard), ["term"], [F.length("official").desc(), F.col("official")], related, "place")
    around = nearest.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("place", "official"))), lambda s: s["official"]).alias("related"))
    joined = terms.join(listed, "term", "left").join(spelled, "term", "left").join(around, "term", "left")
    if vocabulary is None:
        joined = joined.withColumn("parts", F.lit(None).cast("array<string>"))
        missing = F.lit("unchecked")
    else:
        joined = joined.join(segment_terms(terms, vocabulary), "term", "left")
        missing = F.lit("missing")
    return joined.select(
        "code", "term", F.when(F.col("listed"), "listed").when(F.col("official").isNotNull(), "synonym")
        .when(F.size("parts") > 0, "composed").otherwise(missing).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("official")).alias("official"),
        F.coalesce("related", F.array().cast("array<string>")).alias("related"), "parts")


def composed_abbreviations(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Combined abbreviation of each decomposed term."""
    each = parts.where("parts is not null").select("term", F.posexplode("parts").alias("pos", "word"))
    return each.join(vocabulary, "word", "left").groupBy("term").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", F.coalesce("abbr", F.lit("?")).alias("abbr")))), lambda s: s["abbr"]), "_"
    ).alias("abbr"))


def similar_names(targets: DataFrame, standard: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most similar official names per target, as advice only; of equally similar ones the first listed."""
    found = nearest(targets.select(F.col("term").alias("asked")), standard.select(
        F.col("row_no").alias("seq"), values.strip(F.col("term_name")).alias("text")), limit)
    return found.select(F.col("asked").alias("term"), "place", F.col("text").alias("official"), F.bround("ratio", 1).alias("score"))
