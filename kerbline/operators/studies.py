"""Journeys, review queues, funnels and record comparisons of counterfactual studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .spatial import within


def _order(seed: str, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)


def broad_journeys(points: DataFrame, bands: Sequence[tuple[float, float]], size: float, seed: str, per_cell: int = 1) -> DataFrame:
    """(origin, band, destination): hash-drawn origins of each grid cell, and for each distance band the first other point in hash order.

    points: (point_id, x, y). Cells cycle the origins over the area. Destinations come from a grid join of the widest band's radius.
    """
    cell = [F.floor(F.col(c) / size) for c in ("x", "y")]
    drawn = points.withColumns({"_cx": cell[0], "_cy": cell[1], "_o": _order(seed, "point_id")})
    origins = drawn.withColumn("_n", F.row_number().over(W.partitionBy("_cx", "_cy").orderBy("_o"))).filter(F.col("_n") <= per_cell).select(F.col("point_id").alias("origin"), "x", "y")
    pairs = within(origins, points.withColumnRenamed("point_id", "destination"), max(b for _, b in bands)).filter("origin != destination")
    band = F.lit(None).cast("int")
    for i, (a, b) in enumerate(bands):
        band = F.when((F.col("d") >= a) & (F.col("d") < b), i).otherwise(band)
    best = pairs.withColumn("band", band).filter("band is not null").groupBy("origin", "band").agg(F.min(F.struct(_order(seed, "origin", "destination").alias("o"), "destination")).alias("m"))
    return best.select("origin", "band", F.col("m.destination").alias("destination"))


def review_queue(candidates: DataFrame, strata: Sequence[str], per_stratum: int = 8, most: int = 40) -> list[tuple[int, str, object]]:
    """(place, stratum, record) of a review queue; candidates: (stratum, record, score), best by falling score and then record.

    Strata take turns, one record each a round, and no record is taken twice. A turn skips at most the records taken so far, so the best
    `most` of each stratum are all that can be reached: only those (strata x most rows) come to the driver.
    """
    best = candidates.filter(F.col("stratum").isin(*strata)).withColumn("_n", F.row_number().over(W.partitionBy("stratum").orderBy(F.col("score").desc(), "record"))).filter(F.col("_n") <= most)
    lists: dict[str, list] = {s: [] for s in strata}
    for row in best.orderBy("stratum", "_n").select("stratum", "record").collect():
        lists[row.stratum].append(row.record)
    queue, taken = [], set()
    for _ in range(per_stratum):
        for s in strata:
            record = next((r for r in lists[s] if r not in taken), None)
            if record is not None and len(queue) < most:
                taken.add(record)
                queue.append((len(queue) + 1, s, record))
    return queue


def funnel(rows: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """(stage, gate, reached, dropped): how many rows reach each gate in turn and how many it stops; null doesn't pass."""
    alive, sums = F.lit(True), []
    for i, (name, gate) in enumerate(gates.items()):
        passes = F.coalesce(gate, F.lit(False))
        sums += [F.count_if(alive).alias(f"r{i}"), F.count_if(alive & ~passes).alias(f"d{i}")]
        alive = alive & passes
    stages = [F.struct(F.lit(i + 1).alias("stage"), F.lit(name).alias("gate"), F.col(f"r{i}").alias("reached"), F.col(f"d{i}").alias("dropped")) for i, name in enumerate(gates)]
    return rows.agg(*sums).select(F.inline(F.array(*stages)))


def asserted(records: DataFrame, keys: Sequence[str], topics: Mapping[str, Column]) -> DataFrame:
    """(keys, topic, value): one row for each value that a record states; blank and null ones state nothing."""
    rows = records.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("topic"), c.cast("string").alias("value")) for k, c in topics.items()))))
    return rows.filter(F.trim("value") != "")


def compared_records(ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, topic, outcome, ours, theirs): what both sides state about a record's topic; several elements may speak for theirs.

    consistent: all of theirs equal ours; conflict: none does; mixed: some; ours_only, theirs_only. Nothing is resolved.
    """
    on = [*keys, "topic"]
    a = ours.groupBy(*on).agg(F.min("value").alias("ours"))
    b = theirs.groupBy(*on).agg(F.array_sort(F.collect_set("value")).alias("theirs"))
    rows = a.join(b, on, "full")
    fits = F.array_contains("theirs", F.col("ours"))
    outcome = F.when(F.col("theirs").isNull(), "ours_only").when(F.col("ours").isNull(), "theirs_only").when(~fits, "conflict").when(F.size("theirs") > 1, "mixed").otherwise("consistent")
    return rows.select(*on, outcome.alias("outcome"), "ours", "theirs")


def top_decile(rows: DataFrame, measures: Sequence[str], share: float = 0.9) -> DataFrame:
    """rows with hard_<measure>: whether it is above the discrete quantile of all rows; the quantiles are one row."""
    cuts = rows.agg(*(F.expr(f"percentile_disc({share}) within group (order by {m})").alias(f"_c_{m}") for m in measures))
    return rows.crossJoin(F.broadcast(cuts)).withColumns({f"hard_{m}": F.coalesce(F.col(m) > F.col(f"_c_{m}"), F.lit(False)) for m in measures}).drop(*(f"_c_{m}" for m in measures))


def could_move(journeys: DataFrame, segments: DataFrame, cost_per_m: float = 1.0) -> DataFrame:
    """(journey): those that a changed segment may move: going through it as the crow flies is no dearer than the present route.

    journeys: (journey, ox, oy, dx, dy, cost); segments: (x, y). A route through a point costs at least the straight distances, so the others can't
    change. The ellipse around both ends lies within cost / 2 of the middle: a grid join on that bound for each power of two of the cost.
    Journeys of the same ends and cost are asked once, and so are places.
    """
    ends = ["ox", "oy", "dx", "dy", "cost"]
    reach = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("cost") / cost_per_m / 2, F.lit(1e-6)))))
    asked = journeys.select(*ends).distinct().withColumns({"_size": reach, "_mx": (F.col("ox") + F.col("dx")) / 2, "_my": (F.col("oy") + F.col("dy")) / 2})
    around = F.explode(F.array(*(F.struct((F.floor(F.col("_mx") / F.col("_size")) + i).alias("cx"), (F.floor(F.col("_my") / F.col("_size")) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sizes = asked.select("_size").distinct()  # a few dozen powers of two at most
    placed = segments.select("x", "y").distinct().crossJoin(F.broadcast(sizes)).withColumns({"cx": F.floor(F.col("x") / F.col("_size")), "cy": F.floor(F.col("y") / F.col("_size"))})
    rows = asked.withColumn("_c", around).select("*", "_c.cx", "_c.cy").join(placed, ["_size", "cx", "cy"])
    legs = [(F.col(a) - F.col("x")) * (F.col(a) - F.col("x")) + (F.col(b) - F.col("y")) * (F.col(b) - F.col("y")) for a, b in (("ox", "oy"), ("dx", "dy"))]
    movable = rows.filter((F.sqrt(legs[0]) + F.sqrt(legs[1])) * cost_per_m <= F.col("cost")).select(*ends).distinct()
    return journeys.join(movable, ends, "left_semi").select("journey").distinct()


def equivalent_values(penalties: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """(values, profiles): groups of attribute values that cost the same under every profile; penalties: keys and a map of value to penalty."""
    rows = penalties.select(*keys, F.explode(table).alias("value", "penalty"))
    shape = rows.groupBy("value").agg(F.array_sort(F.collect_list(F.struct(*keys, "penalty"))).alias("costs"))
    return shape.groupBy("costs").agg(F.array_sort(F.collect_list("value")).alias("values")).select("values", F.size("costs").alias("profiles"))


def located(points: DataFrame, tiers: Sequence[tuple[str, DataFrame, float]], otherwise: str, key: str = "point_id") -> DataFrame:
    """(key, place): the first tier that has a target within its radius of the point; a grid semi-join for each tier."""
    out = points.select(key)
    for i, (_, targets, radius) in enumerate(tiers):
        near = within(points.select(key, "x", "y"), targets.select("x", "y"), radius).select(key).distinct().withColumn(f"_t{i}", F.lit(True))
        out = out.join(near, key, "left")
    place = F.lit(otherwise)
    for i, (name, _, _) in reversed(list(enumerate(tiers))):
        place = F.when(F.col(f"_t{i}"), name).otherwise(place)
    return out.select(key, place.alias("place"))
