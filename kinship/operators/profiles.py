"""Normalised records: what every later operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinship.functions import text
from kinship.functions.scripts import to_latin


def profiles(records: DataFrame, translit: Column | None = None) -> DataFrame:
    """records (entity_id, business_name, business_address, country, src) with token arrays, legal forms, aliases, postal codes and keys."""
    latin = records.withColumns({"__name": to_latin(F.col("business_name")), "__address": to_latin(F.col("business_address"))})
    parsed = latin.withColumns({"__n": text.name_parts(F.col("__name"), translit), "__a": text.address_parts(F.col("__address"))})
    flat = parsed.select("entity_id", "src", "country", text.country_key(F.col("country")).alias("country_key"), F.col("business_name").alias("raw_name"), F.col("business_address").alias("raw_addr"), F.col("__n.core").alias("core"), F.col("__n.legal").alias("legal"), F.col("__n.extra").alias("extra"), F.col("__n.alias").alias("alias"), F.col("__a.tokens").alias("addr"), F.col("__a.postal").alias("postal"), F.col("__a.landmark").alias("landmark"))
    return with_views(flat)


def with_views(profile: DataFrame) -> DataFrame:
    """Adds what follows from core, addr and postal: skeletons, numbers, acronym, house number."""
    core, addr, postal = F.col("core"), F.col("addr"), F.col("postal")
    landmarks = text.array_of(text.words.LANDMARKS)
    house = text.house_numbers(addr, postal)
    # the first number that isn't the postal code, wherever that stands
    first = F.get(F.filter(text.numbers(addr), lambda t: t != postal), F.lit(0))
    bare = F.regexp_replace(first, "^0+(?=[0-9])", "")
    return profile.withColumns(
        {
            "core_text": F.array_join("core", " "),
            "addr_text": F.array_join("addr", " "),
            "skeleton": F.array_join(F.transform(core, text.skeleton), " "),
            "name_numbers": F.array_distinct(text.numbers(core)),
            "acronym": text.acronym(core),
            "addr_words": text.letters(addr),
            "addr_numbers": F.array_distinct(house),
            "first_number": F.coalesce(F.get(house, F.lit(0)), F.lit("")),
            "addr_skeleton": F.array_join(F.transform(F.filter(text.letters(addr), lambda t: ~F.array_contains(landmarks, t)), text.skeleton), " "),
            "house": F.substring(bare, 1, 15).cast("long"),
            "house_digits": F.least(F.length(bare), F.lit(15)),
        }
    )


def token_idf(tokens: DataFrame) -> DataFrame:
    """(token, idf) over records given as one array column; a token counts once for a record, and idf = ln((N + 1) / (df + 1)) + 1."""
    column = tokens.columns[0]
    total = tokens.agg(F.count("*").alias("n"))
    counts = tokens.select(F.explode(F.array_distinct(column)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counts.crossJoin(total).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def with_weights(profile: DataFrame, column: str, idf: DataFrame, out: str) -> DataFrame:
    """Adds each record's tokens' weights as an array beside the tokens, so that pairs needn't look any up."""
    tokens = profile.select("entity_id", F.posexplode(column).alias("pos", "token")).join(idf, "token")
    made = tokens.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idf"))), lambda x: x["idf"]).alias(out))
    return profile.join(made, "entity_id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<double>")))


def weighted_profiles(profile: DataFrame) -> DataFrame:
    """Adds core_weight and addr_weight, by the split's own idf."""
    with_core = with_weights(profile, "core", token_idf(profile.select("core")), "core_weight")
    return with_weights(with_core, "addr_words", token_idf(profile.select("addr_words")), "addr_weight")


def learn_translit(pairs: DataFrame, least_count: int = 3, least_share: float = 0.5, latin_below: int = 3) -> DataFrame:
    """(token, english) learned from true pairs (s1_id, name_s1, name_match): names of equally many tokens are aligned by position.

    Only pairs of a Latin and an Indic name teach; the most frequent counterpart wins (ties: the smaller), if it is
    frequent enough, has its share, and the token is rare in Latin names. Leave hold-out records out of pairs.
    """
    indic = lambda c: F.col(c).rlike("[\\u0900-\\u0DFF]")
    latin = pairs.filter(~indic("name_s1")).withColumns({"__s1": to_latin(F.col("name_s1")), "__match": to_latin(F.col("name_match"))})
    both = latin.filter(indic("name_match")).select(text.raw_name_tokens(F.col("__s1")).alias("y"), text.raw_name_tokens(F.col("__match")).alias("x")).filter(F.size("x") == F.size("y"))
    met = both.select(F.explode(F.arrays_zip("x", "y")).alias("p")).select("p.x", "p.y").filter((F.col("x") != F.col("y")) & ~text.is_number(F.col("x")))
    return translit_table(met, latin.select("s1_id", "__s1").distinct().select(F.explode(text.raw_name_tokens(F.col("__s1"))).alias("token")), least_count, least_share, latin_below)


def translit_table(met: DataFrame, latin_tokens: DataFrame, least_count: int = 3, least_share: float = 0.5, latin_below: int = 3) -> DataFrame:
    """(token, english) from aligned tokens (x, y) and the tokens of Latin names."""
    counted = met.groupBy("x", "y").agg(F.count("*").alias("n"))
    best = counted.groupBy("x").agg(F.max(F.struct(F.col("n"), F.lit(0))).alias("top"), F.sum("n").alias("total"))
    first = counted.join(best, "x").filter(F.col("n") == F.col("top.n")).groupBy("x").agg(F.min("y").alias("y"), F.first("n").alias("n"), F.first("total").alias("total"))
    latin = latin_tokens.groupBy("token").agg(F.count("*").alias("k"))
    kept = first.filter((F.col("n") >= least_count) & (F.col("n") >= least_share * F.col("total"))).join(latin, F.col("x") == F.col("token"), "left").filter(F.coalesce("k", F.lit(0)) < latin_below)
    return kept.select(F.col("x").alias("token"), F.col("y").alias("english"))
