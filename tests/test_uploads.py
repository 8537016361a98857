"""Uploads as they come: a result per file, an end mark per job, whatever the order, also after a restart."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import uploads as U


def put(folder, job, n, name="a.png", content=b"x"):
    (folder / job).mkdir(parents=True, exist_ok=True)
    (folder / job / f"{n:04d}_{name}").write_bytes(content)


def manifest(folder, job, files):
    folder.mkdir(exist_ok=True)
    (folder / f"{job}.json").write_text(json.dumps({"job_id": job, "files": files}))


def extract(batch):
    return batch.select("job_id", "idx", "name", F.concat(F.lit("read "), F.decode("content", "utf-8")).alias("data"))


def events(spark, at, files="files"):
    stream = U.upload_stream(spark, f"{at}/{files}", per_batch=3)
    rows = U.run_uploads(spark, stream, f"{at}/manifests", extract, f"{at}/out").collect()
    return sorted((r["job_id"], r["event"], r["idx"] or 0, r["data"] or "", r["files"] or 0) for r in rows)


def test_files_and_manifests_in_any_order(spark, tmp_path):
    """Job a is whole at once; b's last file and c's manifest come later; d has no files; e never ends; a file that comes again gives no event."""
    files = tmp_path / "files"
    for n in (1, 2):
        put(files, "a", n, content=f"a{n}".encode())
    put(files, "b", 1)
    put(files, "b", 2, "notes.txt")
    put(files, "c", 1, content=b"c")
    put(files, "e", 1)
    manifest(tmp_path / "manifests", "a", 2)
    manifest(tmp_path / "manifests", "b", 2)
    manifest(tmp_path / "manifests", "d", 0)
    manifest(tmp_path / "manifests", "e", 9)
    first = [("a", "done", 0, "", 2), ("a", "result", 1, "read a1", 0), ("a", "result", 2, "read a2", 0), ("b", "result", 1, "read x", 0), ("c", "result", 1, "read c", 0), ("d", "done", 0, "", 0), ("e", "result", 1, "read x", 0)]
    assert events(spark, tmp_path) == first
    put(files, "b", 3, "b.JPG")
    put(files, "a", 2, "again.png")
    manifest(tmp_path / "manifests", "c", 1)
    assert events(spark, tmp_path) == sorted([*first, ("b", "result", 3, "read x", 0), ("b", "done", 0, "", 2), ("c", "done", 0, "", 1)])


def test_restart_gives_equal_output(spark, tmp_path, monkeypatch):
    """A run that fails while it writes a batch, started again, ends with the events of one that didn't fail."""
    for at in (tmp_path / "failed", tmp_path / "whole"):
        for job in "ab":
            for n in range(1, 6):
                put(at / "files", job, n, content=f"{job}{n}".encode())
            at.mkdir(exist_ok=True)
            manifest(at / "manifests", job, 5)
    failing = {"left": 2}
    plain = extract

    def fails(batch):
        failing["left"] -= 1
        if failing["left"] == 0:
            raise RuntimeError("lost")
        return plain(batch)

    monkeypatch.setitem(globals(), "extract", fails)
    with pytest.raises(Exception, match="lost"):
        events(spark, tmp_path / "failed")
    monkeypatch.setitem(globals(), "extract", plain)
    got = events(spark, tmp_path / "failed")
    assert got == events(spark, tmp_path / "whole") and len(got) == 12
