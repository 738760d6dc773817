"""Hashes of all files of a bundle: names without a dot, and paths that also lead to other files."""

import hashlib

from cairn.jobs import catalogue
from cairn.sources import files


def hash_of(content):
    return files.ERROR if content is None else "sha256:" + hashlib.sha256(content.encode()).hexdigest()


def test_every_file_of_the_bundle_is_hashed(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = sorted((r.path, hash_of(r.content)) for r in catalogue.file_table(spark, sf_dir).collect())
    assert any("." not in path.rpartition("/")[2] for path, _ in want)
    assert sorted(map(tuple, catalogue.src_file_hash(spark, sf_dir).collect())) == want


def test_paths_that_lead_to_others(spark, monkeypatch):
    rows = [("/", "root"), ("/a", "one"), ("/a/b", None), ("/a/b/c", "two"), ("a", "three"), ("a=/b-", "four"), ("a=", None), ("/_x/.y", "five"), ("a b/%20+c", ""), ("/a/b-", "six"), ("/é/=-", "seven")]
    table = spark.createDataFrame([(p, p, c) for p, c in rows], "path string, canonical string, content string")
    monkeypatch.setattr(catalogue, "file_table", lambda *_: table)
    assert sorted(map(tuple, catalogue.src_file_hash(spark, "").collect())) == sorted((p, hash_of(c)) for p, c in rows)
    monkeypatch.setattr(catalogue, "file_table", lambda *_: table.limit(0))
    assert catalogue.src_file_hash(spark, "").collect() == []
