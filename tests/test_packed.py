"""Packed vector files: parts, offsets, files of tasks, and what is an error."""

import numpy as np
import pytest

from cairn.sources import files, packed


def rows(df):
    return {r["id"]: list(r["embedding"]) for r in df.collect()}


@pytest.mark.parametrize("names", [[f"id{i:04d}" for i in range(500)], [f"é{'x' * (i % 7)}{i}" for i in range(500)], ["a"]])
def test_round_trip_in_parts(spark, tmp_path, names):
    data = [(n, [float(np.float32(i / 3)), -0.5, float(i)]) for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "id string, embedding array<float>").repartition(3)
    path = f"file://{tmp_path}/v"
    assert files.write_vectors(df, path, 3, stride=16) == len(names)
    assert not [p for p in (tmp_path / "v").iterdir() if p.is_dir()]
    back = files.read_vectors(spark, path, partBytes="512")
    assert rows(back) == dict(data)
    if len(names) > 1:
        assert back.rdd.getNumPartitions() > len(list((tmp_path / "v").glob("*.bin")))


def test_a_file_without_offsets(spark, tmp_path):
    raw = files.pack_vectors([(f"n{'y' * (i % 5)}{i}", [float(i), 1.0]) for i in range(300)], 2)
    (tmp_path / "f.bin").write_bytes(raw)
    back = files.read_vectors(spark, f"file://{tmp_path}/f.bin", partBytes="256")
    assert back.rdd.getNumPartitions() == 1 and len(rows(back)) == 300
    same = files.pack_vectors([(f"{i:03d}", [float(i), 1.0]) for i in range(300)], 2)
    (tmp_path / "g.bin").write_bytes(same)
    back = files.read_vectors(spark, f"{tmp_path}/g.bin", partBytes="256")
    assert back.rdd.getNumPartitions() > 10 and rows(back)["299"] == [299.0, 1.0]


def test_many_files_of_a_task(spark, tmp_path):
    spark.dataSource.register(packed.PackedVectors)
    df = spark.range(100).selectExpr("cast(id AS string) AS id", "array(cast(id AS float)) AS embedding").coalesce(1)
    df.write.format("packed_vectors").option("fileBytes", 200).mode("overwrite").save(str(tmp_path / "v"))
    assert len(list((tmp_path / "v").glob("*.bin"))) > 3
    assert len(rows(files.read_vectors(spark, str(tmp_path / "v")))) == 100
    df.limit(5).write.format("packed_vectors").mode("append").save(str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).count() == 105


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "id string, embedding array<float>"
    assert files.write_vectors(spark.createDataFrame([], schema), f"{tmp_path}/none", 4) == 0
    assert files.write_vectors(spark.createDataFrame([("a", None), (None, [1.0]), ("b", [1.0, 2.0]), ("c", [3.0])], schema), f"{tmp_path}/some", 1) == 1
    spark.dataSource.register(packed.PackedVectors)
    with pytest.raises(Exception, match="width"):
        spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], schema).coalesce(1).write.format("packed_vectors").mode("overwrite").save(f"{tmp_path}/bad")
    assert not list((tmp_path / "bad").glob("*.bin"))


def test_what_is_not_a_vector_file(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"something else altogether")
    with pytest.raises(Exception, match="not a vector file"):
        files.read_vectors(spark, f"{tmp_path}/x.bin").collect()
    (tmp_path / "y.bin").write_bytes(files.pack_vectors([("a", [1.0]), ("bbb", [2.0])], 1)[:-1])
    with pytest.raises(Exception, match="ends within a row"):
        files.read_vectors(spark, f"{tmp_path}/y.bin").collect()


def test_rows_that_only_look_alike(spark, tmp_path):
    (tmp_path / "z.bin").write_bytes(files.pack_vectors([("bb", [1.0]), ("a", [2.0]), ("ccc", [3.0])], 1))
    with pytest.raises(Exception, match="rows=varying"):
        files.read_vectors(spark, f"{tmp_path}/z.bin").collect()
    assert len(rows(files.read_vectors(spark, f"{tmp_path}/z.bin", rows="varying"))) == 3
