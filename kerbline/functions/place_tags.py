"""What a tagged feature is as a place, an address or a street. tags: map<string, string>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import code_of, initialism, normalise

# Keys of places in the order that decides what a feature is called, and which values count.
PLACE_KEYS = ("amenity", "shop", "tourism", "leisure", "healthcare", "office", "craft", "historic", "public_transport", "railway", "place", "building")
RAILWAY_PLACES = ("station", "halt", "tram_stop")
TRANSIT_PLACES = ("station", "platform")
TRANSIT_HIGHWAYS = ("bus_stop", "platform")
PATH_HIGHWAYS = ("footway", "path", "cycleway", "bridleway", "track", "corridor")
EXCLUDED_HIGHWAYS = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "abandoned", "razed", "raceway", "bus_guideway")
OTHER_NAMES = ("alt_name", "short_name", "official_name", "loc_name", "old_name")
CODE_KEYS = ("ref", "short_name")


def _tag(tags: Column, key: str) -> Column:
    """The trimmed value, empty if there is none."""
    return F.trim(F.coalesce(tags[key], F.lit("")))


def name(tags: Column) -> Column:
    """The name, or null."""
    return F.nullif(_tag(tags, "name"), F.lit(""))


def place_category(tags: Column) -> Column:
    """What a named feature is, in words, or null if it is no place: the first of PLACE_KEYS with a value that counts."""

    def said(key: str) -> Column:
        value = F.lower(_tag(tags, key))
        readable = F.replace(value, F.lit("_"), F.lit(" "))
        counts = (value != "") & (value != "no")
        if key == "railway":
            counts &= value.isin(*RAILWAY_PLACES)
        if key == "public_transport":
            return F.when(counts & value.isin(*TRANSIT_PLACES), F.concat(F.lit("transit "), readable))
        if key == "building":
            return F.when(counts, F.when(readable == "yes", "building").otherwise(F.concat(readable, F.lit(" building"))))
        return F.when(counts, F.when(readable == "yes", key).otherwise(readable))

    stop = F.when(tags["highway"].isin(*TRANSIT_HIGHWAYS), "transit stop")
    return F.coalesce(stop, *map(said, PLACE_KEYS))


def street_category(tags: Column) -> Column:
    """What a named way is, or null if nobody searches for it."""
    highway = F.lower(_tag(tags, "highway"))
    no = (highway == "") | highway.isin(*EXCLUDED_HIGHWAYS, *TRANSIT_HIGHWAYS, "steps")
    return F.when(~no, F.when(highway.isin(*PATH_HIGHWAYS), "path").when(highway == "pedestrian", "pedestrian street").otherwise("street"))


def address(tags: Column) -> Column:
    """struct(housenumber, street, city), null without number or street."""
    number, street = _tag(tags, "addr:housenumber"), _tag(tags, "addr:street")
    return F.when((number != "") & (street != ""), F.struct(number.alias("housenumber"), street.alias("street"), F.nullif(_tag(tags, "addr:city"), F.lit("")).alias("city")))


def is_candidate(tags: Column) -> Column:
    """Whether a feature is a named place or an address."""
    return (name(tags).isNotNull() & place_category(tags).isNotNull()) | address(tags).isNotNull()


def place_codes(tags: Column) -> Column:
    """The distinct short codes of a place, in the order of CODE_KEYS and of their values."""
    values = F.flatten(F.array(*(F.split(_tag(tags, k), ";") for k in CODE_KEYS)))
    return F.array_distinct(F.filter(F.transform(values, lambda v: code_of(F.trim(v))), lambda c: c.isNotNull()))


def place_initialisms(tags: Column) -> Column:
    """Initials of a place's name and official name."""
    return F.array_distinct(F.filter(F.array(initialism(name(tags)), initialism(F.nullif(_tag(tags, "official_name"), F.lit("")))), lambda c: c.isNotNull()))


def entry(tags: Column) -> Column:
    """struct(kind, label, category, searched): how a candidate is listed, a place before an address; null for others.

    A place's address is part of its label; searched holds its other names too, before normalise().
    """
    own, at, category = name(tags), address(tags), place_category(tags)
    door = F.concat_ws(" ", at["housenumber"], at["street"])
    others = F.filter(F.flatten(F.array(*(F.split(_tag(tags, k), ";") for k in OTHER_NAMES))), lambda v: F.trim(v) != "")
    place = F.struct(
        F.lit("place").alias("kind"), F.when(at.isNull(), own).otherwise(F.concat(own, F.lit(", "), door)).alias("label"), category.alias("category"),
        F.concat_ws(" ", own, F.when(at.isNotNull(), door), F.array_join(others, " ")).alias("searched"),
    )
    label = F.concat_ws(", ", door, at["city"])
    listed = F.struct(F.lit("address").alias("kind"), label.alias("label"), F.lit("address").alias("category"), label.alias("searched"))
    return F.when(own.isNotNull() & category.isNotNull(), place).when(at.isNotNull(), listed)


def search_text(searched: Column) -> Column:
    return normalise(searched)
