"""Models leave as files, all of a job or none."""

import os

import pytest
from pyspark.sql import functions as F

from pathloom.sources import model_files, models


def files(folder):
    return sorted(os.path.join(os.path.relpath(d, folder), f) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_")))


def test_one_file_a_model_and_back(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("p1", "<a>\n1</a>"), ("../up/ü", "<b/>"), ("same", "<c/>"), ("same", "<d/>"), (None, "<e/>"), ("none", None), (".hidden", "<f/>"), ("", "<g/>"), ("long" * 200, "<h/>")]
    df = spark.createDataFrame(rows, "pathway_id string, xml string").coalesce(1)
    model_files.write(df, folder)
    got = files(folder)
    assert len(got) == 7 and all(f.startswith("part-00000") for f in got)
    assert {os.path.basename(f) for f in got if "long" not in f} == {"p1.xml", "%2Fup%2F%C3%BC.xml", "same.xml", "same~2.xml", "hidden.xml", "unnamed.xml"}
    assert os.path.exists(f"{folder}/_SUCCESS") and not os.path.exists(f"{folder}/_temporary")
    assert {r.xml for r in models.read_texts(spark, folder).collect()} == {t for k, t in rows if k is not None and t is not None}
    model_files.write(df.where("pathway_id = 'p1'"), folder)
    assert len(files(folder)) == 8
    model_files.write(df.where("pathway_id = 'p1'"), folder, mode="overwrite")
    assert len(files(folder)) == 1
    model_files.write(df.limit(0), folder, mode="overwrite")
    assert files(folder) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    model_files.write(spark.range(3).select(F.col("id").alias("pathway_id"), F.lit("<x/>").alias("xml")), folder)
    before = files(folder)
    bad = spark.range(40).repartition(4).select(F.col("id").alias("pathway_id"), F.when(F.col("id") < 39, "<y/>").otherwise(F.raise_error(F.lit("broken"))).alias("xml"))
    with pytest.raises(Exception, match="broken"):
        model_files.write(bad, folder, mode="overwrite")
    assert files(folder) == before and not os.path.exists(f"{folder}/_temporary")
