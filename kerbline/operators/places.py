"""Ranked place search over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx

FUZZY_LEAST = 0.6
"""Least word similarity of the fuzzy pass: the default of pg_trgm's <% operator."""
LIMIT = 8
FUZZY_TIER = 9
# Stops named after what they serve, and features that are rarely where somebody means to go.
TRANSIT = ("transit stop", "transit station", "transit platform", "bus station", "station", "halt", "tram stop")
INCIDENTAL = (
    "artwork", "atm", "bench", "bicycle parking", "charging station", "clock", "drinking water", "information", "motorcycle parking", "parcel locker", "parking", "parking entrance", "parking space",
    "post box", "recycling", "shelter", "taxi", "telephone", "toilets", "vending machine", "waste basket",
)


def _rank_order(w):
    fuzzy = F.when(F.col("tier") == FUZZY_TIER, F.col("similarity"))  # comes first in the fuzzy pass, fourth in the exact one
    return w.orderBy("tier", fuzzy.desc(), "kind_rank", "category_rank", F.col("similarity").desc(), "text_length", "place_id")


def category_rank(category: Column) -> Column:
    """0 for a place someone is likely going to, 1 for transit, 2 for incidentals."""
    return F.when(category.isin(*INCIDENTAL), 2).when(category.isin(*TRANSIT), 1).otherwise(0)


def with_code(queries: DataFrame) -> DataFrame:
    """queries with code, the text as a code is written: their own, or the compacted text where they have none."""
    small = tx.compact(F.col("text"))
    return queries.withColumn("code", F.coalesce("code", small) if "code" in queries.columns else small)


def exact_hits(queries: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, place_id, ..., tier): 0 code, 1 whole text, 2 code beginning, 3 initialism, 4 text beginning, 5 and 6 whole text and text
    beginning of transit, 7 the rest. Tiers 1 to 4 are for categories of rank 0.

    Distinct query texts meet distinct searchable contents by two equi-joins in one: the first term on word beginnings, and the text as a
    code is written (column code of queries, else the compacted text) on codes, their beginnings of two or more characters and initialisms.
    Queries and places are joined to the distinct matches.
    """
    content = ["search_text", "codes", "initialisms"]
    terms = F.filter(F.split("search_text", " "), lambda w: w != "")

    def starts(words: Column, least: int) -> Column:
        of = lambda w: F.when(F.char_length(w) >= least, F.transform(F.sequence(F.lit(least), F.char_length(w)), lambda n: F.substr(w, F.lit(1), n))).otherwise(F.array(w))
        return F.flatten(F.transform(F.filter(words, lambda w: w.isNotNull()), of))

    def keys(kind: str, words: Column) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(kind), w))

    none = F.array().cast("array<string>")
    queries = with_code(queries)
    filled = places.withColumns({"codes": F.coalesce("codes", none), "initialisms": F.coalesce("initialisms", none)})
    codes = F.transform("codes", lambda c: F.lower(c))
    index = filled.select(*content).distinct().withColumn("key", F.explode(F.array_distinct(F.concat(keys("t", starts(terms, 1)), keys("c", starts(codes, 2)), keys("c", F.col("initialisms"))))))
    asked = queries.select("text", "code").distinct().withColumn("terms", tx.terms(F.col("text"))).filter(F.size("terms") > 0)
    asked = asked.withColumns({"query": F.array_join("terms", " "), "key": F.explode(F.array(F.concat(F.lit("t"), F.get("terms", F.lit(0))), F.concat(F.lit("c"), F.col("code"))))})
    small = F.col("code")
    # How texts match doesn't depend on the category, so it is found once for all places with one content; the tier is given afterwards.
    how = {
        "by_code": F.array_contains(codes, small), "by_start": (F.char_length(small) >= 2) & F.exists(codes, lambda c: F.startswith(c, small)), "by_initials": F.array_contains("initialisms", small),
        "whole": F.col("search_text") == F.col("query"), "begins": F.startswith("search_text", "query"), "by_terms": tx.matches_terms(F.col("search_text"), F.col("terms")),
    }
    flags = [F.coalesce(c, F.lit(False)).alias(k) for k, c in how.items()]
    found = asked.join(index, "key").select("text", "code", *content, *flags).filter("by_code or by_start or by_initials or by_terms").distinct()
    rank = category_rank(F.col("category"))
    tier = (
        F.when(F.col("by_code"), 0).when((rank == 0) & F.col("whole"), 1).when((rank == 0) & F.col("by_start"), 2).when((rank == 0) & F.col("by_initials"), 3)
        .when((rank == 0) & F.col("begins"), 4).when((rank == 1) & F.col("whole"), 5).when((rank == 1) & F.col("begins"), 6).otherwise(7)
    )
    return queries.join(found, ["text", "code"]).drop("code").join(filled, content).withColumn("tier", tier).drop(*how)


def fuzzy_hits(queries: DataFrame, places: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """(query_id, place_id, ..., tier 9): places whose text has the query's word similarity at least.

    Distinct texts of both sides meet on trigrams, which are counted before anything else of them is joined back. The share of the
    query's trigrams that a text has is an upper bound of its word similarity, so what is under it is dropped before texts are compared.
    """
    q = queries.select("text").distinct().withColumn("query", F.array_join(tx.terms(F.col("text")), " ")).withColumn("trigrams", tx.trigrams(F.col("query")))
    p = places.select("search_text").distinct().withColumn("p_trigrams", tx.trigrams(F.col("search_text")))
    shared = q.select("text", "query", F.size("trigrams").alias("nq"), F.explode("trigrams").alias("t")).join(p.select("search_text", F.explode("p_trigrams").alias("t")), "t")
    near = shared.groupBy("text", "query", "search_text", "nq").agg(F.count("*").alias("c")).filter(F.col("c") >= least * F.col("nq") - 1e-9)
    near = near.select("text", "search_text", tx.word_similarity(F.col("query"), F.col("search_text")).alias("_s")).filter(F.col("_s") >= least - 1e-9)
    return near.select("text", "search_text").join(queries, "text").join(places, "search_text").withColumn("tier", F.lit(FUZZY_TIER))


def most_similar(queries: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, place_id, similarity): for each query (query_id, text) the place (place_id, search_text) of another id whose text is the most
    similar; ties go to the least id, and so does a query that shares no trigram with any.

    Distinct texts meet on trigrams; a text that shares none has similarity 0, so the least ids stand for all of those. Only a query's own id
    is no answer to it, so the two best of a text, each found text standing by its two least ids, serve all queries of that text.
    """
    q = queries.select("text").distinct().withColumn("trigrams", tx.trigrams(F.col("text")))
    p = places.select("search_text").distinct().withColumn("trigrams", tx.trigrams(F.col("search_text")))
    shared = q.select("text", F.size("trigrams").alias("nq"), F.explode("trigrams").alias("t")).join(p.select("search_text", F.size("trigrams").alias("np"), F.explode("trigrams").alias("t")), "t")
    near = shared.groupBy("text", "search_text", "nq", "np").agg(F.count("*").alias("c")).select("text", "search_text", (F.col("c") / (F.col("nq") + F.col("np") - F.col("c"))).alias("similarity"))
    heads = places.select("search_text", "place_id").distinct().withColumn("_i", F.row_number().over(W.partitionBy("search_text").orderBy("place_id"))).filter("_i <= 2").drop("_i")
    order = W.partitionBy("text").orderBy(F.col("similarity").desc(), "place_id")
    two = near.join(heads, "search_text").withColumn("_i", F.row_number().over(order)).filter("_i <= 2").select("text", "place_id", "similarity")
    found = queries.join(two, "text").select("query_id", "place_id", "similarity")
    least = places.select("place_id").orderBy("place_id").limit(2)
    none = queries.select("query_id").crossJoin(F.broadcast(least)).withColumn("similarity", F.lit(0.0))
    best = F.min(F.struct((-F.col("similarity")).alias("neg"), F.col("place_id").alias("id"))).alias("best")
    return found.union(none).filter("query_id != place_id").groupBy("query_id").agg(best).select("query_id", F.col("best.id").alias("place_id"), (-F.col("best.neg")).alias("similarity"))


def search(queries: DataFrame, places: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, rank, place_id, label, tier, similarity) for queries (query_id, text, already normalised; optionally
    code, the text as typed in small letters and digits only, with no abbreviation expanded).

    places: place_id, kind, label, category, search_text, codes, initialisms. The fuzzy pass runs only for queries that the exact one
    leaves empty; of places with one kind, label and category the best ranked stays. similarity is that of whole texts, in the fuzzy
    pass word similarity.
    """
    # Places that only differ in their id rank as one: the least id.
    places = places.groupBy("kind", "label", "category", "search_text", "codes", "initialisms").agg(F.min("place_id").alias("place_id"))
    exact = exact_hits(queries, places)
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    hits = exact.unionByName(fuzzy_hits(rest, places).select(*exact.columns))
    number_first = F.col("text").rlike("^[0-9]")
    kind = F.when(F.col("kind") == "address", F.when(number_first, 0).otherwise(2)).when(F.col("kind") == "place", F.when(number_first, 1).otherwise(0)).otherwise(F.when(number_first, 2).otherwise(1))
    # Texts repeat over many hits, so each pair of texts is compared once. A text's hits are all exact or all fuzzy.
    pairs = hits.select("text", "search_text", (F.col("tier") == FUZZY_TIER).alias("fuzzy")).distinct()
    query = F.array_join(tx.terms(F.col("text")), " ")
    exact_pairs = pairs.filter("not fuzzy").withColumn("similarity", tx.similarity(query, F.col("search_text")))
    fuzzy_pairs = pairs.filter("fuzzy").withColumn("similarity", tx.word_similarity(query, F.col("search_text")))
    pairs = exact_pairs.union(fuzzy_pairs)
    hits = hits.withColumn("fuzzy", F.col("tier") == FUZZY_TIER).join(pairs, ["text", "search_text", "fuzzy"])
    hits = hits.withColumns({"kind_rank": kind, "category_rank": category_rank(F.col("category")), "text_length": F.char_length("search_text")})
    one = hits.withColumn("_i", F.row_number().over(_rank_order(W.partitionBy("query_id", "kind", "label", "category")))).filter("_i = 1")
    ranked = one.withColumn("rank", F.row_number().over(_rank_order(W.partitionBy("query_id")))).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "place_id", "label", "tier", F.round("similarity", 6).alias("similarity"))


def deduplicated(entries: DataFrame, size: float = 0.002) -> DataFrame:
    """One entry for each kind, text and grid cell: the best tier, then the first to arrive."""
    keys = ["kind", "search_text", F.floor(F.col("lon") / size), F.floor(F.col("lat") / size)]
    return entries.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("tier", "arrival"))).filter("_i = 1").drop("_i")
