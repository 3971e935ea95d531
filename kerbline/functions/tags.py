"""Map tags to known, unknown or denied attributes. Absence of a tag is never evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# The tag vocabularies of the street network.
PAVED = ("paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "metal", "wood", "rubber", "tartan", "acrylic")
COMPACTED = ("compacted", "fine_gravel", "gravel_turf", "chipseal")
ROUGH = ("unpaved", "gravel", "ground", "dirt", "earth", "grass", "sand", "mud", "cobblestone", "cobblestone:flattened", "pebblestone", "rock", "woodchips", "grass_paver")
SURFACE_ORDER = ("asphalt", "concrete", "paved", "concrete:plates", "concrete:lanes", "paving_stones", "metal", "wood", "rubber", "tartan", "acrylic", "chipseal", "compacted", "fine_gravel", "gravel_turf", "sett", "cobblestone:flattened", "cobblestone", "pebblestone", "grass_paver", "unpaved", "gravel", "woodchips", "ground", "dirt", "earth", "grass", "rock", "sand", "mud")
SMOOTHNESS_ORDER = ("excellent", "good", "intermediate", "bad", "very_bad", "horrible", "very_horrible", "impassable")
SMOOTHNESS_CLASS = {"excellent": "excellent", "good": "good", "intermediate": "intermediate", "bad": "bad", "very_bad": "bad", "horrible": "bad", "very_horrible": "bad", "impassable": "bad"}
ACCESS = {"yes": "yes", "designated": "designated", "permissive": "permissive", "destination": "destination", "private": "private", "no": "no", "customers": "destination", "official": "designated"}
KERB = {"lowered": "lowered", "flush": "flush", "raised": "raised", "rolled": "rolled", "no": "none", "yes": "present_unknown"}
KERB_ORDER = ("no", "flush", "lowered", "rolled", "yes", "raised")
KERB_SEVERITY = ("none", "flush", "lowered", "unknown", "rolled", "present_unknown", "raised")
WALKABLE = ("footway", "path", "pedestrian", "steps", "living_street", "residential", "service", "track", "cycleway", "unclassified", "tertiary", "secondary", "primary", "corridor", "crossing", "elevator", "platform")
TRUE, FALSE = ("yes", "true", "1"), ("no", "false", "0")
ALLOW, REVERSED = (*TRUE, "designated", "permissive", "destination", "official"), ("-1", "reverse", "backward")


def lookup(values: Mapping[str, str], key: Column, default: str | None = None) -> Column:
    """The value of key in a fixed table."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    found = F.element_at(table, F.coalesce(key, F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def all_values(raw: Column) -> Column:
    """Distinct lower-case values of a tag that may hold several, joined by semicolons, in order."""
    parts = F.transform(F.split(F.lower(raw), ";"), lambda v: F.trim(v))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda v: v != "")), F.array().cast("array<string>"))


def first_value(raw: Column) -> Column:
    return F.get(all_values(raw), F.lit(0))


def is_conflicted(raw: Column) -> Column:
    return F.size(all_values(raw)) > 1


def worst_of(raw: Column, order: Sequence[str]) -> Column:
    """The value that stands last in order (best first); values outside it are worse than all, the first of equals wins."""
    ranks = F.array(*map(F.lit, order))
    values = all_values(raw)
    ranked = F.transform(values, lambda v, i: F.struct((F.coalesce(F.nullif(F.array_position(ranks, v), F.lit(0)), F.lit(len(order) + 1))).alias("rank"), (-i).alias("turn"), v.alias("value")))
    return F.array_max(ranked)["value"]


def tri_state(raw: Column) -> Column:
    """yes, no or unknown; any other value asserts presence."""
    v = first_value(raw)
    return F.when(v.isNull(), "unknown").when(v.isin(*FALSE), "no").otherwise("yes")


def access(raw: Column) -> Column:
    return lookup(ACCESS, first_value(raw), "unknown")


def surface_class(raw: Column) -> Column:
    v = worst_of(raw, SURFACE_ORDER)
    return F.when(v.isin(*PAVED), "paved").when(v.isin(*COMPACTED), "compacted").when(v.isin(*ROUGH), "rough").otherwise("unknown")


def smoothness_class(raw: Column) -> Column:
    return lookup(SMOOTHNESS_CLASS, worst_of(raw, SMOOTHNESS_ORDER), "unknown")


def kerb(tags: Column) -> Column:
    """The kerb tag of a way, or else its curb tag."""
    return lookup(KERB, worst_of(F.coalesce(tags["kerb"], tags["curb"]), KERB_ORDER), "unknown")


def node_evidence(tags: Column) -> dict[str, Column]:
    """What a node says: its kerb (barrier=kerb asserts one of unknown height), whether it is a crossing and of which type, tactile paving."""
    named = worst_of(tags["kerb"], KERB_ORDER)
    paving = first_value(tags["tactile_paving"])
    return {
        "kerb": F.when(named.isNotNull(), lookup(KERB, named, "unknown")).when(first_value(tags["barrier"]) == "kerb", "present_unknown").otherwise("unknown"),
        "is_crossing_node": F.coalesce(first_value(tags["highway"]) == "crossing", F.lit(False)),
        "crossing_type": first_value(tags["crossing"]),
        "tactile_paving": F.when(paving.isNull(), "unknown").when(paving.isin(*FALSE), "no").otherwise("yes"),
        "barrier": first_value(tags["barrier"]),
    }


def worst_kerb(kerbs: Column) -> Column:
    """The severest of an array of kerb types; null for an empty one."""
    order = F.array(*map(F.lit, KERB_SEVERITY))
    return F.array_max(F.transform(kerbs, lambda k: F.struct(F.array_position(order, k).alias("rank"), k.alias("kerb"))))["kerb"]


def whole_number(raw: Column) -> Column:
    """The number cut to a whole one ("12.0" is 12), null below 0 or if it is none."""
    n = first_value(raw).try_cast("double")
    return F.when(n > -1, n.cast("int"))


def positive_number(raw: Column) -> Column:
    """The digits, points and minus signs of the text as a number above 0 ("1.5 metres" is 1.5), else null."""
    n = F.regexp_replace(first_value(raw), r"[^\d.\-]", "").try_cast("double")
    return F.when(n > 0, n)


def steps(tags: Column) -> Column:
    """Stairs are a kind of way: another walkable kind says "no", no kind says nothing."""
    highway = first_value(tags["highway"])
    return F.when(highway == "steps", "yes").when(highway.isin(*WALKABLE), "no").otherwise("unknown")


def step_count(tags: Column) -> Column:
    return F.when(steps(tags) != "no", whole_number(tags["step_count"]))


def incline_percent(raw: Column) -> Column:
    """A slope in percent from '4%', '-4', '3deg' or '1/12', the first of several; words like up and down give no number."""
    text = first_value(raw)
    number, unit = r"^([-+]?\d+(?:\.\d+)?)\s*", {"percent": r"%?$", "degrees": r"(?:°|deg)$", "ratio": r"/\s*(\d+(?:\.\d+)?)$"}
    found = {k: F.nullif(F.regexp_extract(text, number + u, 1), F.lit("")).try_cast("double") for k, u in unit.items()}
    run = F.nullif(F.regexp_extract(text, number + unit["ratio"], 2), F.lit("")).try_cast("double")
    return F.coalesce(found["percent"], F.tan(F.radians(found["degrees"])) * 100, F.try_divide(found["ratio"] * 100, run))


def incline_direction(raw: Column) -> Column:
    n, v = incline_percent(raw), first_value(raw)
    return F.when(v.isin("up", "down"), v).when(n > 0, "up").when(n < 0, "down").otherwise("unknown")


def conveying(tags: Column) -> Column:
    v = first_value(tags["conveying"])
    return F.when(v.isNull() | v.isin(*FALSE), "none").when(v.isin("forward", "reversible"), v).when(v.isin(*REVERSED), "backward").otherwise("unknown_direction")


def reversed_conveying(value: Column) -> Column:
    return F.coalesce(lookup({"forward": "backward", "backward": "forward"}, value), value)


def foot_direction(tags: Column) -> Column:
    """struct(forward, backward, reason, ambiguous): what a person on foot may do, each statement over the ones before.

    A bare oneway binds on stairs only; oneway:foot follows, then foot:forward and foot:backward, then the direction in which a moving
    walkway carries, which yields to oneway:foot=no only. What can't be read changes nothing and makes the segment ambiguous, as does a
    walkway of unknown direction. If both ways come out denied the tags contradict each other: both stay open and it is ambiguous.
    """
    def among(key: str, values: Sequence[str]) -> Column:
        return F.coalesce(first_value(tags[key]).isin(*values), F.lit(False))

    def unread(key: str, *known: Sequence[str]) -> Column:
        return first_value(tags[key]).isNotNull() & ~among(key, [v for k in known for v in k])

    binds = among("highway", ("steps", "via_ferrata"))
    ahead, back = F.lit(True), F.lit(True)
    for key, applies in (("oneway", binds), ("oneway:foot", F.lit(True))):
        turned, onward = applies & among(key, REVERSED), applies & among(key, ALLOW)
        ahead, back = F.when(turned, False).when(onward, True).otherwise(ahead), F.when(turned, True).when(onward, False).otherwise(back)
    both = among("oneway:foot", FALSE)
    ahead, back = both | ahead, both | back
    ahead = F.when(among("foot:forward", FALSE), False).when(among("foot:forward", ALLOW), True).otherwise(ahead)
    back = F.when(among("foot:backward", FALSE), False).when(among("foot:backward", ALLOW), True).otherwise(back)
    carried = conveying(tags)
    ahead, back = ahead & (both | (carried != "backward")), back & (both | (carried != "forward"))
    shut = ~ahead & ~back
    doubt = unread("oneway:foot", FALSE, REVERSED, ALLOW) | unread("foot:forward", FALSE, ALLOW) | unread("foot:backward", FALSE, ALLOW) | (carried == "unknown_direction")
    said = {
        "oneway": binds & among("oneway", (*REVERSED, *ALLOW)), "oneway:foot": first_value(tags["oneway:foot"]).isNotNull(), "foot:forward": first_value(tags["foot:forward"]).isNotNull(),
        "foot:backward": first_value(tags["foot:backward"]).isNotNull(), "conveying": (carried == "unknown_direction") | (~both & carried.isin("forward", "backward")), "contradiction": shut,
    }
    reason = F.array_join(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in said.items()))), "; ")
    return F.struct((ahead | shut).alias("forward"), (back | shut).alias("backward"), reason.alias("reason"), (doubt | shut).alias("ambiguous"))


def vehicle_oneway_ignored(tags: Column) -> Column:
    """Whether the way has a oneway rule, which as such is one for vehicles."""
    return F.coalesce(~first_value(tags["oneway"]).isin(*FALSE), F.lit(False))


def is_crossing(tags: Column) -> Column:
    kinds = [F.coalesce(first_value(tags[k]) == "crossing", F.lit(False)) for k in ("highway", "footway", "cycleway")]
    return kinds[0] | kinds[1] | kinds[2] | F.coalesce(~first_value(tags["crossing"]).isin("no", "separate"), F.lit(False))


def edge_features(tags: Column) -> dict[str, Column]:
    """All attributes of a segment, as flat columns."""
    directions = foot_direction(tags)
    return {
        "highway": first_value(tags["highway"]),
        "foot_access": access(tags["foot"]),
        "general_access": access(tags["access"]),
        "steps": steps(tags),
        "step_count": step_count(tags),
        "surface": worst_of(tags["surface"], SURFACE_ORDER),
        "surface_class": surface_class(tags["surface"]),
        "smoothness": worst_of(tags["smoothness"], SMOOTHNESS_ORDER),
        "smoothness_class": smoothness_class(tags["smoothness"]),
        "incline_percent": incline_percent(tags["incline"]),
        "incline_direction": incline_direction(tags["incline"]),
        "kerb": kerb(tags),
        "sidewalk": first_value(tags["sidewalk"]),
        "is_crossing": is_crossing(tags),
        "crossing_type": first_value(tags["crossing"]),
        **{k: tri_state(tags[k]) for k in ("tactile_paving", "lit", "indoor", "bridge", "tunnel")},
        "width_m": positive_number(tags["width"]),
        "conveying": conveying(tags),
        "foot_forward": directions["forward"],
        "foot_backward": directions["backward"],
        "direction_reason": directions["reason"],
        "ambiguous_direction": directions["ambiguous"],
        "vehicle_oneway_ignored": vehicle_oneway_ignored(tags),
        "conflicts": F.array_compact(F.array(*(F.when(is_conflicted(tags[k]), F.lit(k)) for k in ("surface", "smoothness", "incline", "width", "kerb", "foot", "access")))),
    }


def effective_grade(mapped: Column, derived: Column) -> Column:
    """struct(percent, source, disagreement): the mapped slope before the one from heights, and how far that is from it where both exist."""
    source = F.when(mapped.isNotNull(), "osm_incline").when(derived.isNotNull(), "derived_elevation")
    return F.struct(F.coalesce(mapped, derived).alias("percent"), source.alias("source"), (derived - mapped).alias("disagreement"))


def unknown_attributes(features: Mapping[str, Column] | None = None) -> Column:
    """Names of the attributes that nobody recorded."""
    f = features or {k: F.col(k) for k in ("surface_class", "smoothness_class", "steps", "effective_grade", "is_crossing", "kerb")}
    return F.array_compact(F.array(
        F.when(f["surface_class"] == "unknown", F.lit("surface")),
        F.when(f["smoothness_class"] == "unknown", F.lit("smoothness")),
        F.when(f["steps"] == "unknown", F.lit("steps")),
        F.when(f["effective_grade"].isNull(), F.lit("incline")),
        F.when(f["is_crossing"] & (f["kerb"] == "unknown"), F.lit("kerb")),
    ))


def derived_grade(start_m: Column, end_m: Column, length_m: Column, resolution_m: Column | float, cap: float = 25.0) -> Column:
    """Percent rise between two heights; null where the piece is too short for the raster's resolution or beyond belief."""
    grade = F.try_divide((end_m - start_m) * 100, length_m)
    shortest = F.greatest(F.lit(8.0), 5 * (resolution_m if isinstance(resolution_m, Column) else F.lit(float(resolution_m))))
    return F.when((length_m >= shortest) & (F.abs(grade) <= cap), F.round(grade, 2))
