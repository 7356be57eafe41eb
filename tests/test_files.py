"""Integrity of files of any size."""

import hashlib

import pytest

from tabsieve.operators.clean import IntegrityError
from tabsieve.sources import files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "small file.bin").write_bytes(b"abc")
    (tmp_path / "blocks.bin").write_bytes(bytes(range(256)) * 5000)
    return tmp_path


def test_whole_files_and_blocks(spark, folder):
    got = {r.file: (r.bytes, r.sha256) for r in files.file_hashes(spark, str(folder)).collect()}
    files_ = [p for p in folder.iterdir() if p.stat().st_size]  # Spark lists no empty files
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files_}
    blocks = {(r.file, r.offset): (r.bytes, r.sha256) for r in files.file_blocks(spark, str(folder), 300_000).collect()}
    raw = (folder / "blocks.bin").read_bytes()
    want = {("blocks.bin", i): (len(raw[i:i + 300_000]), hashlib.sha256(raw[i:i + 300_000]).hexdigest()) for i in range(0, len(raw), 300_000)}
    assert blocks == want | {("small file.bin", 0): (3, hashlib.sha256(b"abc").hexdigest())}


def test_file_beyond_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "large.bin", "wb") as f:  # sparse: takes no disk
        f.truncate(size)
    row = files.file_hashes(spark, str(tmp_path)).first()
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(zeros)
    digest.update(bytes(size % (1 << 20)))
    assert (row.bytes, row.sha256) == (size, digest.hexdigest())
    blocks = files.file_blocks(spark, str(tmp_path), 64 << 20)
    assert blocks.count() == -(-size // (64 << 20)) and blocks.agg({"bytes": "sum"}).first()[0] == size


def test_manifest_policies(spark, folder):
    known = {r.file: r.sha256 for r in files.file_hashes(spark, str(folder)).collect()}
    assert files.verify_files(spark, str(folder), known).filter("NOT ok").count() == 0
    wrong = known | {"blocks.bin": "0" * 64}
    assert [r.file for r in files.verify_files(spark, str(folder), wrong, "warn").filter("NOT ok").collect()] == ["blocks.bin"]
    with pytest.raises(IntegrityError, match=r"blocks\.bin"):
        files.verify_files(spark, str(folder), wrong)
