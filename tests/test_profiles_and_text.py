import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid import registry
from lumengrid.operators import profiles, tiles
from lumengrid.sources import frames as io


def test_profiles_merge_without_the_frames(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, k % 4, np.round(rng.normal(size=500), 2).tolist() + [float("nan"), None, 0.0, -0.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "image_id long, part int, values array<double>")
    profiles.profile(df, "part").write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    found = profiles.estimates(profiles.merge(stored), (0.1, 0.5, 0.9)).first()
    values = np.array([x for *_, v in rows for x in v if x is not None and x == x])
    assert (found.n, found.min, found.max) == (len(values), values.min(), values.max()) and found["mean"] == pytest.approx(values.mean())
    assert found.n_distinct == pytest.approx(len(np.unique(values)), rel=0.05)
    for q, x in zip((0.1, 0.5, 0.9), found.quantiles, strict=True):
        assert (values < x).mean() - 0.02 <= q <= (values <= x).mean() + 0.02
    direct = profiles.estimates(profiles.profile(df)).first()
    assert direct.n_distinct == found.n_distinct and direct.n == found.n
    more = profiles.merge(stored.unionByName(profiles.profile(df.where("part = 1"), "part")), "part")
    assert {r.part: r.n for r in more.collect()}[1] == 2 * {r.part: r.n for r in stored.collect()}[1]
    assert profiles.profile(df.limit(0), "part").count() == 0


def test_text_matrices_in_splits(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=(700, 9)), "b": rng.normal(size=(1, 1)), "c": rng.normal(size=(30, 200))}
    for name, x in data.items():
        (tmp_path / f"{name}.txt").write_text("\n\n".join(" \t".join(map(repr, row.tolist())) for row in x) + "\n")
    (tmp_path / "ragged.txt").write_text("1 2\n3\n")
    (tmp_path / "words.txt").write_text("1 2\n3 x\n")
    (tmp_path / "empty.txt").write_text("\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        lines = io.read_matrix_text_tiles(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() >= 1
        splits = spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        found = {r.path.rsplit("/", 1)[1][0]: r for r in tiles.to_frames(lines.where("values is not null")).collect()}
        nulls = {r.path.rsplit("/", 1)[1] for r in lines.where("values is null").select("path").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 20 and nulls == {"ragged.txt", "words.txt"} and found.keys() == data.keys()
    for name, x in data.items():
        assert (found[name].height, found[name].width) == x.shape and np.array_equal(np.array(found[name]["values"]).reshape(x.shape), x)


def test_many_text_matrices_in_a_file(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = {k: rng.normal(size=(1 + k % 5, 1 + k % 7)) for k in range(200)}
    rows = [(k, *x.shape, x.ravel().tolist()) for k, x in data.items()] + [(200, 1, 2, [1.0, None]), (201, 2, 2, None), (202, 1, 3, [float("nan"), float("inf"), -0.0])]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, values array<double>")
    io.write_matrix_text(df.coalesce(2), f"{tmp_path}/many")
    assert len(list((tmp_path / "many").glob("part-*.txt"))) == 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1 << 27, 997, 100, 64):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = io.read_matrix_text(spark, f"{tmp_path}/many", many=True)
            found = {int(r.name): r for r in back.collect()}
            assert len(found) == back.count() == 203
            assert all((found[k].height, found[k].width) == x.shape and found[k]["values"] == x.ravel().tolist() for k, x in data.items())
            assert found[200]["values"] is None and found[201]["values"] is None and str(found[202]["values"]) == "[nan, inf, -0.0]"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert back.select("image_id").distinct().count() == 203


def test_text_matrices_of_other_writers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n\n1 2\n3 4\n\n\n\n# b\n5\t6\n\n#c \n7 8\n9\n\n# d\n1 x\n\n# e\n1\n# f\n2\n\n\n#g\n 1e3  -2 ")
    found = {r.name: r["values"] for r in io.read_matrix_text(spark, str(tmp_path), many=True).collect()}
    assert found == {None: [1.0, 2.0, 3.0, 4.0], "b": [5.0, 6.0], "c": None, "d": None, "e": None, "g": [1000.0, -2.0]}


def test_files_of_text_do_not_grow_with_frames(spark, sf_dir):
    assert len(registry.QUERIES["matrix_text_roundtrip"](spark, sf_dir).inputFiles()) <= 8
