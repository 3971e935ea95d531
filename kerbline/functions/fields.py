"""Field states, vocabulary relations and evidence signals of inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Codes of a published field that mean "not known" and "does not apply".
UNKNOWN_CODES = {"CURBCUT": ("U",)}
UNKNOWN_DEFAULT = ("UNKNOWN",)
NOT_APPLICABLE = ("NA", "NA (VIRTUAL LINK)")


def field_state(value: Column, published: Column, default: str | float | None = None, domain: Sequence[str | float] | None = None, field: str = "") -> Column:
    """The first that holds: not_published, null, blank, unknown, not_applicable, template_default, out_of_domain, non_default.

    Codes are compared as they are written, text with text and numbers with numbers.
    """
    text = value.cast("string")
    state = F.when(~published, "not_published").when(value.isNull(), "null").when(F.trim(text) == "", "blank")
    state = state.when(text.isin(*UNKNOWN_CODES.get(field, UNKNOWN_DEFAULT)), "unknown").when(text.isin(*NOT_APPLICABLE), "not_applicable")
    if default is not None:
        state = state.when(value == F.lit(default), "template_default")
    if domain is not None:
        state = state.when(~value.isin(*domain), "out_of_domain")
    return state.otherwise("non_default")


def first_rule(rules: Mapping[str, Column], otherwise: str) -> Column:
    """The name of the first rule that holds; a null rule doesn't."""
    out = None
    for name, rule in rules.items():
        out = F.when(F.coalesce(rule, F.lit(False)), name) if out is None else out.when(F.coalesce(rule, F.lit(False)), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


# Wording by which a source tells where it comes from. A word ends wherever letters do, as tags join words by underscores.
IMAGERY_WORDS = r"(?i)ortho|aerial|imagery|photo|satellite"
PUBLIC_IMAGERY = r"(?i)region of waterloo \d{4}|waimagery|geospatial ontario|ontario (imagery|mosaic|orthophoto)|(?<![a-z])swoop(?![a-z])|(?<![a-z])oids(?![a-z])"
CITY = r"(?i)(?<![a-z])kitchener(gis)?(?![a-z])"
NEIGHBOURS = r"(?i)region of waterloo|regionofwaterloo|waterloo region|city of waterloo|(?<![a-z])cambridge(?![a-z])|(?<![a-z])woolwich(?![a-z])"
GOVERNMENT = r"(?i)canvec|geobase|nrcan|statistics canada|statcan|ontario road network|(?<![a-z])orn(?![a-z])|land information ontario|(?<![a-z])lio(?![a-z])|government"
IMPORTED = r"(?i)(?<![a-z])import"
EXTERNAL_DATA = r"(?i)open ?data|local data|proprietary"
SURVEYED = r"(?i)(?<![a-z])survey|(?<![a-z])gps(?![a-z])|(?<![a-z])gnss(?![a-z])|on[- ]the[- ]ground|(?<![a-z])knowledge(?![a-z])|ground truth|(?<![a-z])in person(?![a-z])|streetcomplete|every ?door"
STREET_LEVEL = r"(?i)mapillary|kartaview|openstreetcam|panoramax|mapilio|streetside|streetlevel|street[- ]level"
ESRI = r"(?i)(?<![a-z])esri(?![a-z])|world ?imagery"
NAMED_IMAGERY = r"(?i)(?<![a-z])bing(?![a-z])|mapbox|maxar|digitalglobe|nearmap|vexcel"
GOOGLE = r"(?i)google"
ESRI_MUNICIPAL_SINCE = "2016-02-23"
"""From this day that imagery is the city's own photographs."""


def signals(source: Column, when: Column | None = None) -> Column:
    """Sorted signals of a source string, whose parts (by semicolon) are read one by one; when: the time of the edit that wrote it, as text."""
    def of(part: Column) -> Column:
        says = {k: part.rlike(p) for k, p in {"imagery": IMAGERY_WORDS, "public": PUBLIC_IMAGERY, "city": CITY, "near": NEIGHBOURS, "esri": ESRI}.items()}
        near = says["near"] & ~says["public"]
        municipal = F.lit(True) if when is None else when.isNull() | (when >= ESRI_MUNICIPAL_SINCE)
        found = {
            "public_orthoimagery": says["public"] | ((says["city"] | near) & says["imagery"]) | (says["esri"] & municipal),
            "kitchener_data": says["city"] & ~says["imagery"],
            "other_government_data": (near & ~says["imagery"]) | part.rlike(GOVERNMENT),
            "import_or_external_data": part.rlike(IMPORTED) | part.rlike(EXTERNAL_DATA),
            "survey": part.rlike(SURVEYED),
            "declared_street_level_imagery": part.rlike(STREET_LEVEL),
            "declared_unrelated_imagery": part.rlike(NAMED_IMAGERY) | (says["esri"] & ~municipal),
            "google_named": part.rlike(GOOGLE),
        }
        named = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items())))
        return F.when((F.size(named) == 0) & says["imagery"], F.array(F.lit("unspecified_imagery"))).otherwise(named)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(source, ";"), of))))


def relation(ours: Column, theirs: Column, compatible: Mapping[str, Sequence[str]]) -> Column:
    """agreement, compatible, conflict, or which side alone speaks."""
    fits = first_rule({k: (ours == k) & theirs.isin(*v) for k, v in compatible.items()}, "no") != "no"
    return F.when(ours.isNull() & theirs.isNull(), "unknown").when(theirs.isNull(), "ours_only").when(ours.isNull(), "theirs_only").when(ours == theirs, "agreement").when(fits, "compatible").otherwise("conflict")


def element_ref(raw: Column) -> Column:
    """struct(kind, id, version, problem) of references such as w123@4: a version is required, and version 0 is none."""
    shape = r"^([nwr])([1-9][0-9]*)@(0|[1-9][0-9]*)$"
    kind, number, version = (F.nullif(F.regexp_extract(raw, shape, i), F.lit("")) for i in (1, 2, 3))
    problem = F.when(raw.isNull() | (raw == ""), "missing").when(kind.isNull(), "unrecognised_shape").when(version == "0", "version_zero")
    names = F.when(kind == "n", "node").when(kind == "w", "way").when(kind == "r", "relation")
    return F.struct(names.alias("kind"), number.try_cast("long").alias("id"), F.when(version != "0", version.try_cast("long")).alias("version"), problem.alias("problem"))


def linear_range(between: Column) -> Column:
    """struct(lo, hi, malformed) of a [from, to] pair of fractions; null stands for the whole, which isn't [0, 1]."""
    lo, hi = F.get(between, 0).cast("double"), F.get(between, 1).cast("double")
    sound = (F.size(between) == 2) & F.coalesce((lo >= 0) & (lo < hi) & (hi <= 1), F.lit(False))
    return F.when(between.isNotNull(), F.struct(F.when(sound, lo).alias("lo"), F.when(sound, hi).alias("hi"), (~sound).alias("malformed")))


def age_bucket(days: Column) -> Column:
    return (
        F.when(days.isNull(), "unknown").when(days <= 7, "0-7 days").when(days <= 30, "8-30 days").when(days <= 180, "31-180 days")
        .when(days <= 365, "181-365 days").otherwise("over a year")
    )


def changed(pairs: Mapping[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose two values differ, nulls being equal to each other."""
    return F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in pairs.items())))
