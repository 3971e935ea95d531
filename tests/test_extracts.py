"""Change logs by folder, estimates from footers, hashes in pieces, and extracts that refuse what their manifest doesn't say."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from kerbline.sources import extracts


def changes(spark, n=400):
    i = F.col("id")
    box = F.struct(i.cast("double").alias("xmin"), (i + 1).cast("double").alias("xmax"), i.cast("double").alias("ymin"), (i + 1).cast("double").alias("ymax"))
    kind = F.element_at(F.array(*map(F.lit, ("added", "removed", "data_changed"))), (i % 3 + 1).cast("int"))
    return spark.range(n).select(i.cast("string").alias("id"), F.when(i % 2 == 0, "segment").otherwise("connector").alias("type"), kind.alias("change_type"), F.array().cast("array<string>").alias("columns_changed"), box.alias("bbox"))




def test_changelog_opens_wanted_folders_only(spark, tmp_path):
    path = str(tmp_path / "log")
    extracts.write_changelog(changes(spark), path)
    assert len(list((tmp_path / "log").glob("type=*/change_type=*"))) == 6
    wanted = spark.createDataFrame([("segment", "removed"), ("nothing", "added")], "type string, change_type string").filter("type != 'x'")
    rows = extracts.changelog_scan(spark, path, (100.0, 100.0, 200.0, 200.0), wanted)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "dynamicpruning" in plan.lower()
    assert "GreaterThanOrEqual(bbox.xmax,100.0)" in plan and "LessThanOrEqual(bbox.xmin,200.0)" in plan
    assert sorted(int(r.id) for r in rows.collect()) == [i for i in range(99, 201) if i % 2 == 0 and i % 3 == 1]
    assert extracts.changelog_scan(spark, path, (0.0, 0.0, 1e9, 1e9)).count() == 400


def test_estimates_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    changes(spark, 4000).repartitionByRange(10, F.col("bbox.xmin")).sortWithinPartitions("bbox.xmin").write.parquet(path)
    groups = extracts.row_groups(spark, path)
    assert groups.agg(F.sum("n")).first()[0] == 4000
    boxes = spark.createDataFrame([("mid", 1000.0, 0.0, 1100.0, 4000.0), ("all", 0.0, 0.0, 5000.0, 5000.0), ("none", 9000.0, 0.0, 9001.0, 1.0)], "box_id string, x0 double, y0 double, x1 double, y1 double")
    got = {r.box_id: r for r in extracts.estimate(groups, boxes).collect()}
    assert 101 <= got["mid"].candidate_rows <= 1500
    assert (got["all"].candidate_rows, got["none"].candidate_rows, got["none"].all_rows, got["all"].unknown_groups) == (4000, 0, 4000, 0)
    bare = str(tmp_path / "bare")
    spark.range(10).write.parquet(bare)
    unknown = extracts.estimate(extracts.row_groups(spark, bare), boxes).filter("box_id = 'none'").first()
    assert unknown.candidate_rows == 10 and unknown.unknown_groups >= 1


def test_hashes_in_pieces(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    file = next((tmp_path / "t").glob("*.parquet"))
    data = file.read_bytes()
    for piece in (100, 1 << 20):
        joined = "".join(hashlib.sha256(data[a : a + piece]).hexdigest() for a in range(0, len(data), piece))
        r = extracts.piece_hashes(spark, str(tmp_path / "t"), piece).first()
        assert (r.length, r.sha256) == (len(data), hashlib.sha256(joined.encode()).hexdigest())


@pytest.fixture
def extract(spark, tmp_path):
    folder = tmp_path / "extract"
    rows = changes(spark)
    rows.filter("change_type != 'removed'").select("id", "type", "bbox").write.parquet(f"{folder}/segment")
    rows.write.parquet(f"{folder}/changelog")
    extracts.write_manifest(spark, str(folder), "2024-05", (0.0, 0.0, 9.0, 9.0), ["segment", "changelog"], {"created_at": "now"})
    return folder


SEGMENT = [extracts.Artifact("segment", T.StructType().add("id", "string").add("type", "string"))]


def test_a_true_extract_loads(spark, extract):
    manifest, tables = extracts.load_extract(spark, str(extract), SEGMENT)
    assert manifest["artifacts"]["segment"]["rows"] == tables["segment"].count() == 267
    assert str(extract) not in json.dumps(manifest)
    told = json.loads((extract / "extract-manifest.json").read_text())
    assert extracts.content_sha256(told | {"created_at": "later"}) == manifest["content_sha256"]


@pytest.mark.parametrize("harm", ["edited", "changed", "missing", "added", "contract", "format", "gone", "no artifact"])
def test_a_false_extract_is_refused(spark, extract, harm):
    manifest = extract / "extract-manifest.json"
    file = sorted((extract / "segment").glob("*.parquet"))[0]
    known = SEGMENT
    if harm == "edited":
        manifest.write_text(manifest.read_text().replace("2024-05", "2024-06"))
    elif harm == "format":
        manifest.write_text(manifest.read_text().replace('"extract_version": 1', '"extract_version": 9'))
    elif harm == "gone":
        manifest.unlink()
    elif harm == "changed":
        data = bytearray(file.read_bytes())
        data[len(data) // 2] ^= 1
        file.write_bytes(bytes(data))
    elif harm == "missing":
        file.unlink()
    elif harm == "added":
        (file.parent / "part-more.parquet").write_bytes(file.read_bytes())
    elif harm == "contract":
        known = [extracts.Artifact("segment", T.StructType().add("id", "long"))]
    else:
        known = [extracts.Artifact("connector", T.StructType().add("id", "string"))]
    with pytest.raises(extracts.ExtractMismatchError):
        extracts.load_extract(spark, str(extract), known)


def test_consistency_and_flags(spark):
    rows = changes(spark, 12)
    features = spark.createDataFrame([("0", 1), ("2", 1), ("77", 1), ("8", 1), (None, 1)], "id string, x int").filter("id is not null")
    assert tuple(extracts.consistency(features, rows, "segment").first()) == (1, 1)  # 77 has no change, 6 no feature
    flagged = spark.createDataFrame([("a", "c", "s", (0.0, 1.0, 2.0, 3.0), [1], None), ("b", "c", "s", (0.0, 1.0, 2.0, 3.0), [], [2])], "id string, class string, subclass string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, surface array<int>, width array<int>")
    assert [(r.id, r.xmax, r.has_surface, r.has_width) for r in extracts.with_examined(flagged, ["surface", "width"]).collect()] == [("a", 2.0, True, False), ("b", 2.0, False, True)]


def test_first_files_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(5).write.parquet(path)
    names = sorted(p.name for p in (tmp_path / "t").glob("*.parquet"))[:2]
    got = extracts.first_files(spark, path, 2).select("id", F.input_file_name().alias("f"))
    assert {r.f.rsplit("/", 1)[-1] for r in got.collect()} == set(names)
