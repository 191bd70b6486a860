import gzip
import hashlib
import random

import pytest

from masklake.sources import coco

NAMES = {"text": b"one\ntwo\r\n\nthree\n", "open": b"a\n\n\nb", "ends": b"\n\n\n", "none": b"x" * 5000, "mixed": random.Random(2).randbytes(300_000)}


def _identity(data, path, prefix):
    return path, len(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(data[:prefix]).hexdigest()


@pytest.mark.parametrize("piecewise", [0, 4000, 1 << 28])
def test_files_read_in_pieces_have_the_same_identity(spark, tmp_path, piecewise):
    for name, data in NAMES.items():
        (tmp_path / f"{name} [1]%.bin").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a row cannot hold a file of over 2 GB, so many tasks have to read it
    try:
        found = {tuple(r) for r in coco.file_identity(spark, str(tmp_path), 10, piecewise).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r[0].rsplit("/", 1)[1], *r[1:]) for r in found} == {_identity(data, f"{name} [1]%.bin", 10) for name, data in NAMES.items()}
    assert {r[0] for r in found} == {r[0] for r in coco.file_identity(spark, str(tmp_path), 10).collect()}


def test_an_unpacked_file_is_refused(spark, tmp_path):
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(b"one\ntwo\n" * 1000))
    with pytest.raises(Exception, match="has no identity in pieces"):
        coco.file_identity(spark, str(tmp_path), 10, 10).collect()
