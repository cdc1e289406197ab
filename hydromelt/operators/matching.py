"""Name matching: exact, site-prefixed, similarity and trigram tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt import schemas
from hydromelt.functions import names, similarity, values
from hydromelt.operators.nearest import nearest
from hydromelt.operators.numbering import first_per, top_per
from hydromelt.session import stage, work_splits

_ENTRY = ("dict_type", "code", "variant", "variant_norm")


def lookup_keys(parsed: DataFrame) -> DataFrame:
    """Every key a name may be found under, numbered in order of preference.

    Body first, then bracketed abbreviations, then site-prefixed tails.
    """
    none = F.lit(None).cast("string")
    direct = F.transform(
        F.concat(F.array("body"), F.col("paren_tokens")),
        lambda key, i: F.struct(F.when(i == 0, "body").otherwise("paren").alias("via"),
                                key.alias("key"), none.alias("site")))
    tails = F.transform(F.coalesce("tails", F.array().cast("array<struct<cut:int,body:string,site:string>>")),
                        lambda t: F.struct(F.lit("composite").alias("via"), t["body"].alias("key"),
                                           t["site"].alias("site")))
    return (parsed.select("raw", "body", "paren_tokens", F.posexplode(F.concat(direct, tails)).alias("rank", "k"))
            .select("raw", "body", "paren_tokens", "rank", "k.via", F.nullif("k.key", F.lit("")).alias("key"),
                    "k.site"))


def parse_names(raw_names: DataFrame) -> DataFrame:
    """Distinct names with their normal form and site readings."""
    return (raw_names.select("raw").distinct().repartition(work_splits(raw_names.sparkSession), "raw")
            .withColumn("form", names.normalize_name("raw"))
            .withColumn("tails", names.composite_tails("raw"))
            .select("raw", "form.body", "form.paren_tokens", "tails"))


def first_hits(keyed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The preferred lexicon hit per name, null where no key is known.

    One join and one aggregation on the name serve the exact, abbreviation and
    site-prefix tiers together; the lowest rank is the first tier that hits.
    """
    hit = F.struct("via", "site", *_ENTRY)
    found = keyed.join(lexicon.select(*_ENTRY), F.col("key") == F.col("variant_norm"), "left")
    known = F.col("variant_norm").isNotNull()
    # Grouped by the name alone, whose distinct rows are already placed by it.
    return found.groupBy("raw").agg(
        F.any_value("body").alias("body"), F.any_value("paren_tokens").alias("paren_tokens"),
        F.min_by(F.when(known, hit), F.when(known, F.col("rank"))).alias("hit"))


def exact_lookup(parsed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Exact and abbreviation tiers only."""
    return first_hits(lookup_keys(parsed.withColumn("tails", F.lit(None))), lexicon)


def nearest_entries(undecided: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Most similar lexicon entry per name, however low its score, over the name's body and its bracketed parts.

    Each distinct text is looked up once in an index of the lexicon; of equal scores the earlier part of a name counts, then
    the earlier entry.
    """
    queries = undecided.select("raw", F.posexplode(F.concat(F.array("body"), F.col("paren_tokens"))).alias("part", "asked"))
    found = nearest(queries.select("asked"), lexicon.select(F.col("variant_norm").alias("text"), "seq"))
    order = F.struct(-F.col("ratio"), F.col("part"), F.col("seq"))
    best = queries.join(found, "asked").groupBy("raw").agg(F.min_by(F.struct("ratio", "part", "seq", "text"), order).alias("b"))
    entries = first_per(lexicon.select("seq", *_ENTRY), ["variant_norm"], [F.col("seq")]).drop("seq")
    return best.select("raw", "b.*").join(entries, F.col("text") == F.col("variant_norm")).select(
        "raw", F.bround("ratio", 1).alias("score"), F.when(F.col("part") == 0, "body").otherwise("paren").alias("via"), *_ENTRY)


def map_names(raw_names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Standard code, status and evidence for every distinct name.

    Tiers in fixed order: exact, bracketed abbreviation, site prefix, similarity.
    """
    # Both are read several times; the names are parsed and looked up once.
    lexicon = stage(lexicon.select("seq", *_ENTRY), "lexicon")
    hits = stage(first_hits(lookup_keys(parse_names(raw_names)), lexicon), "hits")
    undecided = hits.where("hit is null")
    near = nearest_entries(undecided, lexicon).select(
        F.col("raw").alias("_raw"), "score",
        F.struct("via", F.lit(None).cast("string").alias("site"), *_ENTRY).alias("near"))
    joined = hits.join(near, F.col("raw") == F.col("_raw"), "left")
    status = (F.when(F.col("hit").isNotNull(), "exact")
              .when(F.col("score") >= C.FUZZY_AUTO_THRESHOLD, "fuzzy_auto")
              .when(F.col("score") >= C.FUZZY_REVIEW_THRESHOLD, "needs_review")
              .otherwise("unmapped"))
    best = F.coalesce("hit", "near")
    part = joined.withColumn("status", status).withColumn(
        "m", F.when(F.col("status") != "unmapped", best))
    return part.select(
        "raw", names.display_name(F.col("body"), F.col("paren_tokens")).alias("normalized"), "status", "m.via",
        F.when(F.col("status").isin(*C.AUTO_STATUSES), F.col("m.code")).alias("code"),
        F.when(F.col("status") == "needs_review", F.col("m.code")).alias("candidate_code"),
        "m.site", F.col("m.variant").alias("matched_variant"), F.col("m.variant_norm").alias("matched_norm"),
        F.when(F.col("hit").isNull(), F.col("score")).alias("score"), "m.dict_type")


def map_columns(columns: DataFrame, mapped: DataFrame) -> DataFrame:
    """Attach name results to file columns and name the output columns."""
    return columns.join(mapped, "raw").withColumn("output_column", values.output_column(
        F.col("status"), F.col("code"), F.col("site"), F.col("raw")))


def apply_overrides(columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace the code of single file columns by reviewed ones.

    Overrides: file_id, column_index, code and an optional dict_type; blank
    codes and unknown positions change nothing.
    """
    fix = overrides.where(values.strip(F.coalesce("code", F.lit(""))) != "").select(
        "file_id", "column_index", F.col("code").alias("_code"), F.col("dict_type").alias("_type"))
    fixed = F.col("_code").isNotNull()
    return (columns.join(fix, ["file_id", "column_index"], "left")
            .withColumn("dict_type", F.coalesce("_type", "dict_type"))
            .withColumn("status", F.when(fixed, "exact").otherwise(F.col("status")))
            .withColumn("via", F.when(fixed, "review").otherwise(F.col("via")))
            .withColumn("code", F.coalesce("_code", "code")).drop("_code", "_type"))


def organisation_override(columns: DataFrame, org_terms: DataFrame) -> DataFrame:
    """An organisation's own alias wins over the shared dictionary.

    ``columns`` carries organization_id, raw and a shared ``code``; ``org_terms``
    holds (organization_id, alias_normalized, standard_code).
    """
    alias = columns.select("raw").distinct().withColumn("alias_normalized", names.alias_key(F.col("raw")))
    own = org_terms.select("organization_id", "alias_normalized", F.col("standard_code").alias("_own"))
    hit = F.col("_own").isNotNull()
    return (columns.join(alias, "raw").join(own, ["organization_id", "alias_normalized"], "left")
            .withColumn("status", F.when(hit, "organization_exact").otherwise(F.col("status")))
            .withColumn("source", F.when(hit, "organization_dictionary").otherwise("global_dictionary"))
            .withColumn("dict_type", F.when(hit, values.dict_type_of(F.col("_own"))).otherwise(F.col("dict_type")))
            .withColumn("output_column", F.coalesce("_own", "output_column"))
            .withColumn("code", F.coalesce("_own", "code")).drop("_own"))


# --- dictionary-table cascade -----------------------------------------------

def _rarest_first(sets: DataFrame, frequency: DataFrame, min_score: float) -> DataFrame:
    """gram, key, size, left: the rarest grams of each key, enough that any match shares one of them.

    Two sets whose overlap reaches the threshold cannot differ in more than
    size - needed of their grams, so only that many plus one need indexing, and
    common grams stay out of the join. ``left``: grams from this one on.
    """
    ranked = (sets.select("key", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
              .join(frequency, "gram").groupBy("key", "size")
              .agg(F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("ranked")))
    needed = F.ceil(F.col("size") * min_score - 1e-9)
    keep = F.slice("ranked", F.lit(1), (F.col("size") - needed + 1).cast("int"))
    return ranked.select("key", "size", F.posexplode(keep["gram"]).alias("place", "gram")).select(
        "gram", "key", "size", (F.col("size") - F.col("place")).alias("left"))


def trigram_pairs(left_keys: DataFrame, right_keys: DataFrame,
                  min_score: float = C.TRIGRAM_MIN_SCORE) -> DataFrame:
    """All pairs of distinct keys whose trigram similarity reaches ``min_score``.

    Candidates come from an equi-join on rare grams: sizes must fit, and enough
    grams must be left in both from the shared one on, which the first shared gram
    of every match satisfies. Only keys are joined; grams follow for distinct candidates.
    """
    def grams(df: DataFrame) -> DataFrame:
        return stage(df.select("key").where(F.col("key") != "").distinct().repartition(
            work_splits(df.sparkSession), "key").withColumn("grams", similarity.trigrams(F.col("key"))), "grams")

    left, right = grams(left_keys), grams(right_keys)
    frequency = left.unionByName(right).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"))
    a, b = (_rarest_first(sets, frequency, min_score).select("gram", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "size", "left")])
            for side, sets in (("left", left), ("right", right)))
    small, large = F.least("left_size", "right_size"), F.greatest("left_size", "right_size")
    enough = F.least("left_left", "right_left") * (1 + min_score) >= min_score * (small + large) - 1e-9
    pairs = a.join(b, "gram").where((small >= large * min_score - 1e-9) & enough).select("left_key", "right_key").distinct()
    return (pairs.join(left.select(F.col("key").alias("left_key"), F.col("grams").alias("ga")), "left_key")
            .join(right.select(F.col("key").alias("right_key"), F.col("grams").alias("gb")), "right_key")
            .withColumn("similarity", similarity.trigram_similarity(F.col("ga"), F.col("gb")))
            .where(F.col("similarity") >= min_score).select("left_key", "right_key", "similarity"))


def nearest_by_trigram(left_keys: DataFrame, right_keys: DataFrame, limit: int, min_score: float = C.TRIGRAM_MIN_SCORE) -> DataFrame:
    """The ``limit`` most similar right keys of each left key; ties by the key."""
    return top_per(trigram_pairs(left_keys, right_keys, min_score), ["left_key"], [F.col("similarity").desc(), F.col("right_key")], limit, "place")


def match_cascade(surfaces: DataFrame, terms: DataFrame, synonyms: DataFrame,
                  min_score: float = C.TRIGRAM_MIN_SCORE, limit: int = C.MATCH_LIMIT) -> DataFrame:
    """Candidate codes per surface: standard name, synonym, then trigram similarity.

    ``terms``: code, term_kind, std_name; ``synonyms``: code, surface, source_id
    (rejected ones already left out). The strongest tier wins per code.
    """
    asked = surfaces.select("surface", names.wq_normalize(F.col("surface")).alias("key")).distinct()
    named = terms.select("code", "term_kind", "std_name", names.wq_normalize(F.col("std_name")).alias("key"))
    spelled = (synonyms.select("code", F.col("surface").alias("via_surface"), F.col("source_id").alias("via_source"),
                               names.wq_normalize(F.col("surface")).alias("syn_key"))
               .join(terms.select("code", "term_kind", "std_name"), "code", "left"))
    out = ["key", "code", "term_kind", "std_name", "tier", "score", "via_surface", "via_source"]
    keys = asked.select("key").distinct()

    def tier(df: DataFrame, rank: int, score: Column) -> DataFrame:
        return df.withColumn("tier", F.lit(rank)).withColumn("score", score.cast("decimal(4,3)")).select(*out)

    standard = tier(keys.join(named, "key").withColumn("via_surface", F.col("std_name")).withColumn(
        "via_source", F.lit(None).cast("string")), 1, F.lit(1.0))
    synonym = tier(keys.join(spelled.withColumnRenamed("syn_key", "key"), "key"), 2, F.lit(0.95))
    pairs = trigram_pairs(keys, spelled.select(F.col("syn_key").alias("key")), min_score)
    fuzzy = tier(pairs.withColumnRenamed("left_key", "key").join(
        spelled, F.col("right_key") == F.col("syn_key")), 3, F.round("similarity", 3))
    every = standard.unionByName(synonym).unionByName(fuzzy)
    rest = ["term_kind", "std_name", "tier", "score", "via_surface", "via_source"]
    order = F.struct("tier", -F.col("score"), "via_surface", "via_source")
    best = every.groupBy("key", "code").agg(F.min_by(F.struct(*rest), order).alias("b")).select("key", "code", "b.*")
    top = top_per(best, ["key"], [F.col("score").desc(), F.col("code")], limit, "rank")
    label = F.element_at(F.array(F.lit("exact_standard"), F.lit("exact_synonym"), F.lit("fuzzy")), F.col("tier"))
    return asked.join(top, "key").select("surface", "rank", "code", "term_kind", "std_name",
                                         label.alias("match_type"), "score", "via_surface", "via_source")


# --- text containment without a cross product --------------------------------

#: Letters of the longest piece that containment looks up.
PIECE = 3


def pieces(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` letters of a text."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def contained_in(short: DataFrame, short_text: str, long: DataFrame, long_text: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pair each ``short`` row with the distinct ``long`` texts that contain its text; empty texts are in none.

    A text that holds another holds its rarest run of three letters (of a shorter text: the text itself), so candidates come
    from one equi-join on that, one row per short text, and every pair comes once. The long side has at most
    three rows per letter; runs that many texts hold are looked up only for texts without a rarer one. ``on`` columns must agree.
    """
    keys = [f"_on{i}" for i in range(len(on))]
    whole = long.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], F.col(long_text).alias("_long")).distinct()
    runs = whole.select(*keys, "_long", F.explode(F.concat(*[pieces(F.col("_long"), n) for n in range(1, PIECE + 1)])).alias("_piece"))
    frequency = runs.groupBy("_piece").agg(F.count("*").alias("_seen"))
    size = F.least(F.length("_short"), F.lit(PIECE))
    texts = short.select(F.col(short_text).alias("_short")).where("_short <> ''").distinct()
    own = texts.select("_short", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("_short") - size + 1), lambda i: F.substring(F.col("_short"), i, size))).alias("_piece"))
    # A run that no long text holds is the rarest, and pairs with nothing.
    rarest = own.join(frequency, "_piece", "left").groupBy("_short").agg(
        F.min_by("_piece", F.struct(F.coalesce("_seen", F.lit(0)), "_piece")).alias("_piece"))
    found = rarest.join(runs, "_piece").where(F.contains("_long", "_short")).drop("_piece")
    same = F.col(short_text) == F.col("_short")
    for c, k in zip(on, keys):
        same = same & (F.col(c) == F.col(k))
    return short.join(found, same).withColumnRenamed("_long", long_text).drop("_short", *keys)
