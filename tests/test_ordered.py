"""The ordered sink: order, headings, whole replacement, failed jobs."""

import pytest
from pyspark.sql import functions as F

from strandlake.sources import ordered, writers


def whole(path):
    return "".join(open(p).read() for p in ordered.parts(path)).splitlines()


def files(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def test_sorted_rows_stay_sorted_under_one_heading(spark, tmp_path):
    path = str(tmp_path / "out")
    track = spark.range(5000).select(F.lit("c").alias("chrom"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end"), F.col("id").alias("value")).repartition(7, "start")
    ordered.write(writers.bedgraph(track), path, ["track a", "# b"])
    assert whole(path) == ["track a", "# b", *[f"c\t{3 * i}\t{3 * i + 2}\t{i}.00000" for i in range(5000)]]
    assert sum(p["rows"] for p in ordered.manifest(path)["parts"]) == 5002 and ordered.read(spark, path).count() == 5000
    assert len(files(tmp_path / "out")) == len(ordered.parts(path)) + 1


def test_a_new_write_replaces_and_an_append_follows(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string").coalesce(1)
    ordered.write(lines("a", None, "é"), path, ["h"])
    ordered.write(lines("b"), path, ["again"], mode="append")
    assert whole(path) == ["h", "a", "", "é", "b"]
    ordered.write(lines("z"), path)
    assert whole(path) == ["z"] and len(files(tmp_path / "out")) == 2


def test_headings_of_empty_results_and_nothing_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    none = spark.createDataFrame([], "value string")
    assert ordered.parts(path) == [] and ordered.read(spark, path).count() == 0
    ordered.write(none, path, ["h"])
    assert whole(path) == ["h"] and ordered.read(spark, path).count() == 0
    ordered.write(none, path)
    assert whole(path) == []


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    ordered.write(spark.createDataFrame([("old",)], "value string"), path, ["h"])
    before = files(tmp_path / "out")
    failing = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception):
        ordered.write(failing, path, ["new"])
    assert whole(path) == ["h", "old"] and files(tmp_path / "out") == before


def test_a_line_is_one_column(spark, tmp_path):
    with pytest.raises(Exception, match="one column"):
        ordered.write(spark.createDataFrame([("a", "b")], "x string, y string"), str(tmp_path / "out"))
