"""Where values and shapes of an edit history come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fields import signals

# What a signal says about an unrelated source, and labels from least to most independent.
NAMED, SHARED = "kitchener_data", ("public_orthoimagery", "other_government_data", "import_or_external_data")
GEOMETRY_EVIDENCE = ("survey", "declared_street_level_imagery", "declared_unrelated_imagery")
TAG_EVIDENCE = ("survey", "declared_street_level_imagery")
DECLARED = ("survey", "declared_street_level_imagery", "declared_unrelated_imagery")
LABELS = ("known", "possible", "unknown", "independent")


def _evidence(source: str, previous: Column, comment: str | None) -> Column:
    """Signals of an edit: those of its changeset's comment, and of a source tag unless it was only carried over."""
    own = F.when(~F.col(source).eqNullSafe(previous), F.col(source))
    found = [signals(own)] + ([signals(F.col(comment))] if comment else [])
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in found))))


def shaping_edits(history: DataFrame, key: str, at: str, shaped: Column, source: str, comment: str | None = None) -> DataFrame:
    """(history columns, evidence): the edits that created an element or changed its shape."""
    before = F.lag(source).over(W.partitionBy(key).orderBy(at))
    return history.withColumn("evidence", _evidence(source, before, comment)).withColumn("_shaped", shaped).filter("_shaped").drop("_shaped")


def introducing_edits(history: DataFrame, key: str, at: str, value: str, source: str, comment: str | None = None) -> DataFrame:
    """(history columns, evidence, confirmations): the edit that last changed an element to its current value.

    confirmations counts the later edits whose evidence has a survey. Elements without a current value have no row.
    """
    w = W.partitionBy(key).orderBy(at)
    rows = history.withColumns({
        "evidence": _evidence(source, F.lag(source).over(w), comment),
        "_new": (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value)),
    })
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    last = rows.groupBy(key).agg(F.max("_run").alias("_run"))
    rows = rows.join(last, [key, "_run"]).filter(F.col(value).isNotNull())
    surveyed = rows.groupBy(key).agg(F.count_if(~F.col("_new") & F.array_contains("evidence", "survey")).alias("confirmations"))
    return rows.filter("_new").drop("_run", "_new").join(surveyed, key)


def decided(edits: DataFrame, key: str, at: str, since: DataFrame, accepted: Sequence[str] = TAG_EVIDENCE, complete: str | None = None, coincident: str | None = None) -> DataFrame:
    """(key, lineage, basis) of the edits that count, one row for each key.

    known: an edit names the publication. possible: an edit shares a source with it, or vertices coincide. independent: the history is
    complete and either the last edit is older than the record (since: key, since), or each edit states an accepted source; basis
    tells the strongest ground: declared, dates or editor_recorded. Otherwise unknown.
    """
    def has(names: Sequence[str]) -> Column:
        return F.arrays_overlap("evidence", F.array(*map(F.lit, names)))

    whole = F.coalesce(F.bool_and(complete), F.lit(False)) if complete else F.lit(True)
    beside = F.coalesce(F.bool_or(coincident), F.lit(False)) if coincident else F.lit(False)
    sums = edits.groupBy(key).agg(
        F.bool_or(has([NAMED])).alias("named"), F.bool_or(has(SHARED)).alias("shared"), F.bool_and(has(accepted)).alias("stated"),
        F.bool_and(has([x for x in accepted if x in DECLARED])).alias("declared"), F.max(at).alias("last"), whole.alias("whole"), beside.alias("beside"),
    )
    rows = sums.join(since.select(key, "since"), key, "left").withColumn("older", F.coalesce(F.col("last") < F.col("since"), F.lit(False)))
    label = F.when(F.col("named"), "known").when(F.col("shared") | F.col("beside"), "possible").when(F.col("whole") & (F.col("older") | F.col("stated")), "independent").otherwise("unknown")
    basis = F.when(label == "independent", F.when(F.col("declared"), "declared").when(F.col("older"), "dates").otherwise("editor_recorded"))
    return rows.select(key, label.alias("lineage"), basis.alias("basis"))


def least_independent(findings: DataFrame, group: str) -> DataFrame:
    """(group, lineage): the least independent lineage of a group's members."""
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.col("lineage"))
    return findings.filter("lineage is not null").groupBy(group).agg(F.min_by("lineage", rank).alias("lineage"))


def earliest(records: DataFrame, key: str, dates: Sequence[str]) -> DataFrame:
    """(key, since): the earliest day among several date columns of all of a key's records."""
    return records.groupBy(key).agg(F.least(*(F.min(F.to_date(d)) for d in dates)).alias("since") if len(dates) > 1 else F.min(F.to_date(dates[0])).alias("since"))


def version_status(theirs: Column, times: Column, ours: Column, our_time: Column, our_snapshot: Column, their_date: Column, their_latest: Column) -> Column:
    """How one element's version and edit time compare across two snapshots; times are fixed-width UTC strings.

    theirs and times are the distinct versions and edit times that the other side cites. Versions decide first. With equal ones, a later
    edit is explained only if it came after the side without it read the map.
    """
    time = F.get(times, 0)
    usable = (F.size(times) == 1) & time.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & our_time.isNotNull()
    version = F.get(theirs, 0)
    return (
        F.when(F.size(theirs) > 1, "ambiguous").when(ours.isNull(), "no_evidence").when(ours < version, "ours_older").when(ours > version, "ours_newer")
        .when(~F.coalesce(usable, F.lit(False)), "time_unverified").when(time == our_time, "exact")
        .when((time > our_time) & F.coalesce(time > our_snapshot, F.lit(False)), "edited_after_our_snapshot").when(time > our_time, "time_inconsistent")
        .when(F.coalesce(F.left(our_time, F.lit(10)) > their_date, F.lit(False)), "edited_after_their_snapshot")
        .when(F.coalesce(our_time <= their_latest, F.lit(False)), "time_inconsistent").otherwise("time_unverified")
    )
