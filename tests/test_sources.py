"""Scans, delimited text and generations."""

import os

from pyspark.sql import functions as F

from recallgrid.sources import files


def test_folder_scan_skips_and_fingerprints(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("sub/b.md", "two"), ("node_modules/c.js", "no"), (".git/x", "no"), ("big.bin", "x" * 200)):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    got = files.scan_folder(spark, str(tmp_path), max_bytes=100).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.txt", "b.md"]
    assert len({r["fingerprint"] for r in got}) == 2


def test_what_a_scan_leaves_out_is_never_opened(spark, tmp_path):
    """A pipe blocks whoever opens it; links lead round in a circle."""
    for folder in ("node_modules/deep", "a/b/c", "dist"):
        (tmp_path / folder).mkdir(parents=True)
    os.mkfifo(tmp_path / "node_modules/deep/pipe")
    os.mkfifo(tmp_path / "a/pipe")
    (tmp_path / "a/b/loop").symlink_to(tmp_path / "a")
    (tmp_path / "a/link.txt").symlink_to(tmp_path / "a/b/real.txt")
    (tmp_path / "a/b/real.txt").write_text("x")
    (tmp_path / "a/b/c/deep.txt").write_text("y")
    (tmp_path / "top.txt").write_text("z")
    names = lambda depth: sorted(r["path"][len(str(tmp_path)) + 1 :] for r in files.scan_folder(spark, str(tmp_path), max_depth=depth).collect())
    assert names(16) == ["a/b/c/deep.txt", "a/b/real.txt", "top.txt"] and names(3) == ["a/b/real.txt", "top.txt"] and names(1) == ["top.txt"]
    assert names(16) == sorted(r["path"][len(str(tmp_path)) + 1 :] for r in files.scan_folder(spark, f"file://{tmp_path}").collect())


def test_many_folders_are_dealt_over_partitions(spark, tmp_path):
    for i in range(80):
        (tmp_path / f"d{i}/e").mkdir(parents=True)
        (tmp_path / f"d{i}/e/f.txt").write_text(str(i))
    got = files.scan_folder(spark, str(tmp_path))
    assert got.count() == 80 and got.select(F.spark_partition_id()).distinct().count() > 40


def test_delimited_text_with_ragged_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n\n1,"x, y"\n2,3,4,5\n')
    got = sorted(tuple(r["cells"]) for r in files.read_delimited(spark, str(tmp_path / "t.csv"), 3).fillna("").collect())
    assert ("a", "b", "c") in got and ("1", "x, y", None) in got and ("2", "3", "4") in got and len(got) == 3


def test_a_new_generation_leaves_the_old(spark, tmp_path):
    path = str(tmp_path / "index")
    files.write_generation(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "generation int, chunk string"), path)
    files.write_generation(spark.createDataFrame([(2, "d")], "generation int, chunk string"), path)
    assert sorted(r["chunk"] for r in files.read_generation(spark, path, 1).collect()) == ["a", "b"]
    assert [r["chunk"] for r in files.read_generation(spark, path, 2).collect()] == ["d"]
