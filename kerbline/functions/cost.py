"""Mobility profiles and the itemised cost of a segment under them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .tags import unknown_attributes

_MAP = T.MapType(T.StringType(), T.DoubleType())
PROFILE = T.StructType(
    [T.StructField("profile", T.StringType(), False), T.StructField("no_steps", T.BooleanType()), T.StructField("no_rough", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("max_incline", "min_width", "steep", "narrow")]
    + [T.StructField(n, _MAP) for n in ("surface_penalty", "smoothness_penalty", "kerb_penalty")]
    + [T.StructField(n, T.DoubleType()) for n in ("incline_penalty", "comfortable", "uncertainty", "step_base", "step_each", "crossing_penalty", "pace_low", "pace_high")]
    + [T.StructField("ignored", T.ArrayType(T.StringType()))]
)


# The presets.
PRESETS: tuple[dict, ...] = (
    {
        "profile": "standard",
        "no_steps": False,
        "no_rough": False,
        "max_incline": None,
        "min_width": None,
        "steep": None,
        "narrow": None,
        "surface_penalty": {},
        "smoothness_penalty": {},
        "kerb_penalty": {},
        "incline_penalty": 0.0,
        "comfortable": 3.0,
        "uncertainty": 0.0,
        "step_base": 0.0,
        "step_each": 0.0,
        "crossing_penalty": 0.0,
        "pace_low": 1.1,
        "pace_high": 1.4,
        "ignored": [],
    },
    {
        "profile": "wheelchair",
        "no_steps": True,
        "no_rough": False,
        "max_incline": None,
        "min_width": None,
        "steep": 8.0,
        "narrow": 0.9,
        "surface_penalty": {"compacted": 0.8, "rough": 12.0, "unknown": 0.5},
        "smoothness_penalty": {"intermediate": 0.7, "bad": 12.0, "unknown": 0.4},
        "kerb_penalty": {"raised": 400.0, "present_unknown": 160.0, "rolled": 300.0, "unknown": 90.0},
        "incline_penalty": 0.55,
        "comfortable": 2.0,
        "uncertainty": 0.3,
        "step_base": 0.0,
        "step_each": 0.0,
        "crossing_penalty": 25.0,
        "pace_low": 0.8,
        "pace_high": 1.2,
        "ignored": [],
    },
    {
        "profile": "walker",
        "no_steps": True,
        "no_rough": False,
        "max_incline": None,
        "min_width": None,
        "steep": 10.0,
        "narrow": 0.75,
        "surface_penalty": {"compacted": 0.5, "rough": 4.0, "unknown": 0.4},
        "smoothness_penalty": {"intermediate": 0.5, "bad": 6.0, "unknown": 0.3},
        "kerb_penalty": {"raised": 200.0, "present_unknown": 100.0, "rolled": 140.0, "unknown": 60.0},
        "incline_penalty": 0.45,
        "comfortable": 2.5,
        "uncertainty": 0.25,
        "step_base": 0.0,
        "step_each": 0.0,
        "crossing_penalty": 20.0,
        "pace_low": 0.5,
        "pace_high": 0.8,
        "ignored": [],
    },
    {
        "profile": "crutches",
        "no_steps": False,
        "no_rough": False,
        "max_incline": None,
        "min_width": None,
        "steep": 15.0,
        "narrow": None,
        "surface_penalty": {"compacted": 0.4, "rough": 1.6, "unknown": 0.35},
        "smoothness_penalty": {"intermediate": 0.4, "bad": 1.8, "unknown": 0.3},
        "kerb_penalty": {"raised": 40.0, "present_unknown": 28.0, "rolled": 25.0, "unknown": 20.0},
        "incline_penalty": 0.5,
        "comfortable": 3.0,
        "uncertainty": 0.2,
        "step_base": 60.0,
        "step_each": 12.0,
        "crossing_penalty": 15.0,
        "pace_low": 0.6,
        "pace_high": 0.9,
        "ignored": [],
    },
    {
        "profile": "stroller",
        "no_steps": True,
        "no_rough": False,
        "max_incline": None,
        "min_width": None,
        "steep": 12.0,
        "narrow": 0.7,
        "surface_penalty": {"compacted": 0.4, "rough": 1.5, "unknown": 0.3},
        "smoothness_penalty": {"intermediate": 0.35, "bad": 1.5, "unknown": 0.25},
        "kerb_penalty": {"raised": 120.0, "present_unknown": 65.0, "rolled": 90.0, "unknown": 40.0},
        "incline_penalty": 0.3,
        "comfortable": 4.0,
        "uncertainty": 0.15,
        "step_base": 0.0,
        "step_each": 0.0,
        "crossing_penalty": 15.0,
        "pace_low": 1.0,
        "pace_high": 1.3,
        "ignored": [],
    },
    {
        "profile": "reduced_mobility",
        "no_steps": False,
        "no_rough": False,
        "max_incline": None,
        "min_width": None,
        "steep": 15.0,
        "narrow": None,
        "surface_penalty": {"rough": 1.0, "unknown": 0.2},
        "smoothness_penalty": {"bad": 1.2, "unknown": 0.2},
        "kerb_penalty": {"raised": 30.0, "present_unknown": 20.0, "rolled": 18.0, "unknown": 12.0},
        "incline_penalty": 0.4,
        "comfortable": 3.5,
        "uncertainty": 0.12,
        "step_base": 40.0,
        "step_each": 6.0,
        "crossing_penalty": 10.0,
        "pace_low": 0.7,
        "pace_high": 1.1,
        "ignored": [],
    },
)
MARKED_CROSSINGS = ("traffic_signals", "marked", "zebra")
MAX_PROFILES = 1000
GUIDANCE, ASSUMED_STEPS, DOWNHILL = 6.0, 10, 0.4


def profiles(spark: SparkSession, keys: Sequence[str] | None = None) -> DataFrame:
    """The presets as rows: six, or those named."""
    return spark.createDataFrame([p for p in PRESETS if keys is None or p["profile"] in keys], PROFILE)


def blocked_reason() -> Column:
    """The first declared limit that the segment breaks, or null. A missing fact breaks none."""
    def fact(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    col = F.col
    return (
        F.when(fact(col("foot_access").isin("no", "private")) | fact(col("general_access").isin("no", "private")), "prohibited")
        .when(fact(col("no_steps") & (col("steps") == "yes")), "steps")
        .when(fact(col("effective_grade") > col("max_incline")), "too_steep")
        .when(fact(col("width_m") < col("min_width")), "too_narrow")
        .when(fact(col("no_rough") & (col("surface_class") == "rough")), "rough_surface")
    )


def components() -> dict[str, Column]:
    """Effective metres by cost code, over the columns of a segment and of a profile."""
    col = F.col
    length, grade, share = col("length_m"), col("effective_grade"), F.coalesce(col("unit_share"), F.lit(1.0))

    def positive(c: Column) -> Column:
        return F.coalesce(F.greatest(c, F.lit(0.0)), F.lit(0.0))

    def penalty(table: str, key: str) -> Column:
        return F.coalesce(F.element_at(col(table), col(key)), F.lit(0.0))

    unknown = F.size(F.array_except(unknown_attributes(), F.concat(F.array(F.lit("surface"), F.lit("smoothness")), F.coalesce(col("ignored"), F.array().cast("array<string>")))))
    guided = length * positive(grade - col("steep")) * GUIDANCE
    climb = length * positive(F.abs(grade) - col("comfortable")) * col("incline_penalty") * F.when(grade > 0, 1.0).otherwise(DOWNHILL)
    return {
        "distance": length,
        "surface": length * penalty("surface_penalty", "surface_class"),
        "smoothness": length * penalty("smoothness_penalty", "smoothness_class"),
        "incline": guided + climb,
        "width": length * positive((col("narrow") - col("width_m")) * 100) * 0.1 * GUIDANCE,
        "steps": F.when(col("steps") == "yes", (col("step_base") + col("step_each") * F.coalesce(col("step_count"), F.lit(ASSUMED_STEPS))) * share).otherwise(0.0),
        "kerb": F.when(col("is_crossing"), penalty("kerb_penalty", "kerb") * share).otherwise(0.0),
        "crossing": F.when(col("is_crossing"), col("crossing_penalty") * F.when(col("crossing_type").isin(*MARKED_CROSSINGS), 0.4).otherwise(1.0) * share).otherwise(0.0),
        "uncertainty": length * col("uncertainty") * unknown,
    }


def with_cost(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each segment under each profile: blocked (reason or null), items (map of code to metres) and cost (null if blocked).

    The profiles are a handful of rows (MAX_PROFILES at most, which is checked), so every segment meets each of them in a broadcast
    nested-loop join.
    """
    if chosen.limit(MAX_PROFILES + 1).count() > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    rows = segments.crossJoin(F.broadcast(chosen))
    items = components()
    rows = rows.withColumn("blocked", blocked_reason()).withColumns({f"cost_{k}": v for k, v in items.items()})
    total = sum((F.col(f"cost_{k}") for k in items), F.lit(0.0))
    return rows.withColumn("cost", F.when(F.col("blocked").isNull(), total))


def duration_range(distance: Column) -> Column:
    """Fastest and slowest seconds at a profile's pace."""
    return F.struct((distance / F.col("pace_high")).alias("fastest_s"), (distance / F.col("pace_low")).alias("slowest_s"))
