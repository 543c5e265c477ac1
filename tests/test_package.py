"""Digests of files and packages with a manifest, after damage and failures."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from trackengine.operators import export, package
from trackengine.sources import digests, scratch


def test_digests_are_those_of_the_bytes(spark, tmp_path):
    contents = {
        "plain": b"a\nb\n", "no-end": b"a\nb", "one": b"x", "empty": b"", "only-end": b"\n", "ends": b"\n\n\n", "carriage": b"a\r\nb\r\n", "mark": b"\xef\xbb\xbfa\nb", "mark-end": b"\xef\xbb\xbfa\n",
        "bytes": bytes(range(256)) * 500, "zeros": b"\0" * 70_000, "long": b"".join(b"%d line\n" % k for k in range(60_000)), "packed.gz": gzip.compress(b"inner\n"), "deep/er/file": b"deep",
    }
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")  # files are read by several tasks
    try:
        got = {r["path"].split(f"{tmp_path}/")[1]: r["sha256"] for r in digests.file_digests(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: hashlib.sha256(data).hexdigest() for name, data in contents.items() if data}


@pytest.fixture
def lines(spark):
    return spark.range(500).select((F.col("id") % 3).cast("string").alias("part"), "id", F.concat(F.lit("line ä "), "id").alias("value"))


def wanted(rows):
    return "".join(f"line ä {k}\n" for k in rows).encode()


def test_package_names_parts_by_digest(spark, lines, tmp_path):
    path = f"file://{tmp_path}/p"
    manifest = {r["part"]: r for r in package.write_package(lines, path, "part", ["id"], "doc").collect()}
    assert sorted(manifest) == ["0", "1", "2"]
    for part, r in manifest.items():
        raw = wanted(range(int(part), 500, 3))
        packed = open(f"{tmp_path}/p/parts/{r['name']}", "rb").read()
        assert gzip.decompress(packed) == raw and r["sha256"] == hashlib.sha256(raw).hexdigest()
        assert (r["raw_bytes"], r["packed_bytes"], r["n_lines"]) == (len(raw), len(packed), len(raw.splitlines()))
        assert r["name"] == f"doc.{part}.{r['sha256'][:12]}.txt.gz"
    assert sorted(r["value"] for r in package.read_package(spark, path).collect()) == sorted(f"line ä {k}" for k in range(500))
    assert [r["passed"] for r in package.verify_package(spark, path).collect()] == [True] * 3
    # the same rows, dealt otherwise, make the same files
    again = package.write_package(lines.repartition(7), path, "part", ["id"], "doc")
    assert {r["name"] for r in again.collect()} == {r["name"] for r in manifest.values()} == set(scratch.names_in(spark, f"{path}/parts"))


def test_damage_is_found(spark, lines, tmp_path):
    path = f"file://{tmp_path}/p"
    names = {r["part"]: r["name"] for r in package.write_package(lines, path, "part", ["id"]).collect()}
    flipped, swapped = (f"{tmp_path}/p/parts/{names[k]}" for k in ("0", "1"))
    data = bytearray(open(flipped, "rb").read())
    data[len(data) // 2] ^= 4
    open(flipped, "wb").write(data)
    open(swapped, "wb").write(gzip.compress(wanted(range(1, 500, 3)).replace(b"line", b"lime")))
    for crc in os.listdir(f"{tmp_path}/p/parts"):
        if crc.endswith(".crc"):
            os.remove(f"{tmp_path}/p/parts/{crc}")
    assert {r["part"]: r["passed"] for r in package.verify_package(spark, path).collect()} == {"0": False, "1": False, "2": True}
    os.remove(flipped)
    assert {r["part"]: r["passed"] for r in package.verify_package(spark, path).collect()} == {"0": False, "1": False, "2": True}


def test_a_failed_write_changes_nothing(spark, lines, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/p"
    first = sorted(map(str, package.write_package(lines, path, "part", ["id"]).collect()))
    broken = lines.withColumn("value", F.when(F.col("id") < 400, F.concat("value", F.lit("!"))).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        package.write_package(broken, path, "part", ["id"])
    # after some parts are at their place, but before the manifest
    moved, real = [], scratch.rename_path

    def fail(session, old, new):
        if len(moved) == 2:
            raise OSError("lost")
        moved.append(new)
        real(session, old, new)

    changed = lines.withColumn("value", F.concat("value", F.lit("?")))
    with monkeypatch.context() as patch:
        patch.setattr(scratch, "rename_path", fail)
        with pytest.raises(OSError, match="lost"):
            package.write_package(changed, path, "part", ["id"])
    assert sorted(map(str, package.read_manifest(spark, path).collect())) == first
    assert package.read_package(spark, path).filter("value like '%?'").count() == 0
    assert scratch.names_in(spark, path) == ["manifests", "parts"]  # nothing staged is left
    # the retry finds the parts that are there
    package.write_package(changed, path, "part", ["id"])
    assert package.read_package(spark, path).filter("value like '%?'").count() == 500
    package.prune_package(spark, path)
    assert len(scratch.names_in(spark, f"{path}/parts")) == 3 == package.verify_package(spark, path).filter("passed").count()


def test_no_rows_and_no_package(spark, lines, tmp_path):
    path = f"file://{tmp_path}/p"
    with pytest.raises(ValueError, match="no package"):
        package.read_package(spark, path)
    assert package.write_package(lines.limit(0), path, "part", ["id"]).collect() == []
    assert package.read_package(spark, path).collect() == []


@pytest.mark.parametrize(("name", "version"), [("lps_v5.4.2_lps_core.parquet", "v5.4.2"), ("lps_v5.4..2.parquet", "v5.4"), ("lps_v1.1/lps_x_lps_v2.0-a_lps_v3.0", "v2.0"), ("lps_v1.1/other.parquet", None), ("lps_v7", None), ("lps_v5.x", None)])
def test_version_of_a_file_name(spark, name, version):
    row = spark.createDataFrame([(name,)], "n string").select(export.catalogue_version(F.col("n")).alias("v"))
    if version is None:
        with pytest.raises(Exception, match="no catalogue version"):
            row.collect()
    else:
        assert row.first()["v"] == version
