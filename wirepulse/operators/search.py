"""Place search over regions, countries and the locations of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirepulse.dimensions import places_df
from wirepulse.operators.ranking import top_k_per_group

MAX_HITS = 8
MAX_EVENT_PLACES = 4
PLACE_ALTITUDE = 0.9
LETTERS = 3
_SPACE = " \t\n\r\x0b\x0c"


def event_places(events: DataFrame) -> DataFrame:
    """Distinct event locations, each at its strongest event; ``events`` has effective scores."""
    rank = F.struct((-F.col("effective_intensity")).alias("s"), "global_event_id")
    return (
        events.filter(F.coalesce("action_geo_full_name", F.lit("")) != "")
        .groupBy(F.col("action_geo_full_name").alias("name"))
        .agg(F.min_by(F.struct("lat", "lon"), rank).alias("at"), F.min(rank).alias("rank"))
        .select("name", "at.lat", "at.lon", "rank")
    )


def place_search(events: DataFrame, terms: list[str]) -> DataFrame:
    """(term, position, kind, name, lat, lon, altitude), at most eight hits per term.

    Regions come first, then countries, then the four strongest matching event locations. A term
    shorter than two characters finds nothing. Locations are reduced to distinct names before
    they are matched.
    """
    spark: SparkSession = events.sparkSession
    wanted = [t for t in dict.fromkeys(x.strip().lower() for x in terms) if len(t) >= 2]
    literals = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")

    def matching(df: DataFrame) -> DataFrame:
        hits = F.filter(literals, lambda t: F.contains(F.lower("name"), t))
        return df.withColumn("term", F.explode(hits))

    dim = places_df(spark).withColumn("group", F.when(F.col("kind") == "region", 1).otherwise(2))
    fixed = matching(dim).withColumn(
        "rank", F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("global_event_id"))
    )
    by_rank = Window.partitionBy("term").orderBy("rank")
    found = (
        matching(event_places(events))
        .withColumn("_rn", F.row_number().over(by_rank))
        .filter(F.col("_rn") <= MAX_EVENT_PLACES)
        .select(
            "term", "name", "lat", "lon", "rank",
            F.lit("place").alias("kind"),
            F.lit(PLACE_ALTITUDE).alias("altitude"),
            F.lit(3).alias("group"),
        )
    )
    order = Window.partitionBy("term").orderBy("group", "rank", "name")
    return (
        fixed.select(*found.columns)
        .unionByName(found)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= MAX_HITS)
        .select("term", "position", "kind", "name", "lat", "lon", "altitude")
    )


def _grams(text: Column, letters: int) -> Column:
    """The different runs of so many letters in a text; none in a shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - (letters - 1))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(letters))))
    return F.when(F.length(text) >= letters, runs).otherwise(F.array().cast("array<string>"))


def place_postings(names: DataFrame) -> DataFrame:
    """(gram, name): where each pair and triple of letters occurs in the ``name`` of ``names``, lower-cased."""
    lowered = names.select(F.lower("name").alias("name")).distinct()
    both = F.concat(_grams(F.col("name"), LETTERS - 1), _grams(F.col("name"), LETTERS))
    return lowered.select(F.explode(both).alias("gram"), "name")


def matching_names(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, name) for each name that contains a term of two characters or more.

    Each term is looked up by the rarest of its triples of letters only (by itself, if it has two
    letters), and what is found there is compared with the whole term.
    """
    term = F.col("term")
    own = F.when(F.length(term) < LETTERS, F.array(term)).otherwise(_grams(term, LETTERS))
    wanted = terms.filter(F.length(term) >= LETTERS - 1).select("term", F.explode(own).alias("gram"))
    counted = postings.groupBy("gram").agg(F.count("*").alias("names")).join(wanted, "gram")
    rarest = counted.groupBy("term").agg(F.min(F.struct("names", "gram"))["gram"].alias("gram"))
    return rarest.join(postings, "gram").filter(F.contains("name", "term")).select("term", "name")


def search_places(events: DataFrame, terms: DataFrame) -> DataFrame:
    """``place_search`` for as many terms as rows of ``terms`` (column ``term``), found through an index of the
    letters of place names. Terms are trimmed and lower-cased; equal ones are one; null finds nothing."""
    fixed = places_df(events.sparkSession).select(
        "kind", "name", "lat", "lon", "altitude", F.when(F.col("kind") == "region", 1).otherwise(2).alias("group"),
        F.lit(0.0).alias("strength"), F.lit(0).cast("bigint").alias("event"),
    )
    spots = event_places(events).select(
        F.lit("place").alias("kind"), "name", "lat", "lon", F.lit(PLACE_ALTITUDE).alias("altitude"), F.lit(3).alias("group"),
        F.col("rank.s").alias("strength"), F.col("rank.global_event_id").alias("event"),
    )
    cleaned = F.lower(F.btrim("term", F.lit(_SPACE)))
    wanted = terms.select(cleaned.alias("term")).filter("term is not null").distinct()
    everything = fixed.unionByName(spots)
    found = matching_names(place_postings(everything), wanted).withColumnRenamed("name", "lowered")
    hits = everything.withColumn("lowered", F.lower("name")).join(found, "lowered").drop("lowered")
    # A short term may be in very many names: their strongest are found in parts.
    order = [F.asc("strength"), F.asc("event"), F.asc("name")]
    best = top_k_per_group(hits, ["term", "group"], order, MAX_HITS, ["name"], rank="_nth")
    position = F.row_number().over(Window.partitionBy("term").orderBy("group", *order))
    return (
        best.filter((F.col("group") < 3) | (F.col("_nth") <= MAX_EVENT_PLACES))
        .withColumn("position", position).filter(F.col("position") <= MAX_HITS)
        .select("term", "position", "kind", "name", "lat", "lon", "altitude")
    )
