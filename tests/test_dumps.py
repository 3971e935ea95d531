"""Changeset dumps of many bzip2 streams: whole reads, ranges that skip streams, lookups, and writers that leave nothing behind."""

import bz2
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from kerbline.sources import dumps

WHEN = datetime(2024, 5, 1, 10, 0, tzinfo=timezone.utc)


def xml(n):
    parts = [dumps.HEAD]
    for i in range(10, 10 + 3 * n, 3):
        if i % 4:
            parts.append(f'<changeset id="{i}" created_at="2024-05-01T10:00:00Z" num_changes="{i % 7}" user="no one" uid="5">\n <tag k="comment" v="é {i} &lt;x&gt;"/>\n <tag k="secret" v="x"/>\n</changeset>\n'.encode())
        else:
            parts.append(f'<changeset id="{i}" min_lon="1.5" min_lat="2" max_lon="3" max_lat="4"/>\n'.encode())
    return b"".join([*parts, dumps.TAIL])


def cut_anywhere(folder, text, cuts):
    """A dump whose streams cut the text at any byte, even inside of an opening tag."""
    stops = [0, *sorted(cuts), len(text)]
    (folder / "a.osm.bz2").write_bytes(b"".join(bz2.compress(text[a:b]) for a, b in zip(stops, stops[1:], strict=False)))


@pytest.fixture
def dump(spark, tmp_path):
    dumps.register(spark)
    (tmp_path / "dump").mkdir()
    return str(tmp_path / "dump"), str(tmp_path / "index"), tmp_path / "dump"


def read(spark, path, index, **options):
    return spark.read.format("changesets").options(index=index, **options).load(path)


@pytest.mark.parametrize("seed", range(4))
def test_streams_cut_anywhere(spark, dump, seed):
    path, index, folder = dump
    r = random.Random(seed)
    text = xml(60)
    cuts = {r.randrange(1, len(text)) for _ in range((3, 12, 40, 150)[seed])}
    cuts |= {text.index(b'<changeset id="13"') + 7, text.index(b'<changeset id="16"') + 3, text.index("é".encode()) + 1}
    cut_anywhere(folder, text, cuts)
    dumps.write_index(spark, path, index)
    rows = {x.id: x for x in read(spark, path, index).collect()}
    assert sorted(rows) == list(range(10, 190, 3))
    assert rows[13].tags == {"comment": "é 13 <x>"} and rows[13].num_changes == 6 and rows[13].min_lon is None
    assert rows[13].created_at.replace(tzinfo=rows[13].created_at.tzinfo or timezone.utc) == WHEN
    assert (rows[16].min_lon, rows[16].max_lat, rows[16].tags) == (1.5, 4.0, {})
    assert sorted(x.id for x in read(spark, path, index).filter("id between 40 and 80").collect()) == list(range(40, 81, 3))
    asked = spark.createDataFrame([(i,) for i in (10, 13, 14, 100, 187, 5000, -4, None, 13)], "id long")
    assert sorted(x.id for x in dumps.lookup(spark, path, index, asked).collect()) == [10, 13, 100, 187]


def test_ranges_open_few_streams(spark, dump):
    path, index, folder = dump
    rows = spark.range(5000).select("id", F.lit(WHEN).alias("created_at"), F.lit(None).cast("timestamp").alias("closed_at"), (F.col("id") % 9).alias("num_changes"), *(F.lit(None).cast("double").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")), F.create_map(F.lit("comment"), F.concat(F.lit("c"), "id")).alias("tags"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("changesets").option("streamRows", 100).mode("append").save(path)
    assert len(list(folder.iterdir())) == 3
    dumps.write_index(spark, path, index)
    assert 50 <= spark.read.parquet(index).count() <= 53

    def opened(*filters):
        reader = dumps.ChangesetReader({"path": path, "index": index})
        list(reader.pushFilters(list(filters)))
        return sum(len(p.spans) for p in reader.partitions())

    on = ("id",)
    assert opened() in (50, 51, 52, 53)
    assert opened(dumps.GreaterThanOrEqual(on, 1000), dumps.LessThan(on, 1100)) <= 2
    assert opened(dumps.EqualTo(on, 4321)) == 1
    assert opened(dumps.In(on, (5, 7, 2500, None))) == 2
    assert opened(dumps.GreaterThan(on, 10_000)) == 0
    plan = read(spark, path, index).filter("id >= 1000 and id < 1100")
    assert plan.rdd.getNumPartitions() == 1
    assert [(x.id, x.tags["comment"], x.num_changes) for x in plan.orderBy("id").collect()] == [(i, f"c{i}", i % 9) for i in range(1000, 1100)]
    assert read(spark, path, index, **{"from": 4990}).filter("id > 0").count() >= 10
    assert sorted(x.id for x in read(spark, path, index).select("id", "tags").collect()) == list(range(5000))


def test_another_dump_is_refused(spark, dump):
    path, index, folder = dump
    cut_anywhere(folder, xml(5), {40, 90})
    dumps.write_index(spark, path, index)
    (folder / "b.osm.bz2").write_bytes(bz2.compress(b"more"))
    with pytest.raises(Exception, match="another dump"):
        read(spark, path, index).count()


def test_false_magic_is_no_stream(spark, dump):
    path, index, folder = dump
    cut_anywhere(folder, xml(5), {200})
    with (folder / "a.osm.bz2").open("ab") as f:
        f.write(b"BZh91AY&SYnot a stream")
    assert dumps.streams(spark, path).count() == 2


def test_a_failed_writer_leaves_nothing(spark, dump):
    path, _, folder = dump
    bad = spark.range(10, numPartitions=2).select("id", *(F.lit(None).cast("timestamp").alias(c) for c in ("created_at", "closed_at")), F.when(F.col("id") < 8, 1).otherwise(F.raise_error(F.lit("stop"))).cast("long").alias("num_changes"), *(F.lit(None).cast("double").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")), F.lit(None).cast("map<string,string>").alias("tags"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("changesets").mode("append").save(path)
    assert dumps.files_of(path) == []
