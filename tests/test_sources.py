"""The file scan, as a batch and as a stream that goes on where it stopped."""

from __future__ import annotations

from gristmill.sources import files
from pyspark.sql import functions as F


def put(root, name, content=b"x"):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(content)


def test_outcomes(spark, tmp_path):
    for name in ("a.PDF", "deep/b.jpeg", "c.txt", "no_extension", "deep/er/d.tiff"):
        put(tmp_path, name)
    put(tmp_path, "e.png", b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path)).select("path", "length", "outcome", "message").collect()}
    assert {k: r.outcome for k, r in rows.items()} == {"a.PDF": "accepted", "b.jpeg": "accepted", "d.tiff": "accepted", "c.txt": "refused", "no_extension": "refused"}
    assert rows["c.txt"].message == "unsupported file extension '.txt'; accepted extensions are .pdf, .png, .jpg, .jpeg, .tif, .tiff, .bmp"
    assert rows["no_extension"].message.startswith("unsupported file extension ''") and rows["a.PDF"].message is None


def test_requested(spark, tmp_path):
    put(tmp_path, "a.pdf")
    found = files.scan(spark, str(tmp_path))
    there = found.first().path
    wanted = spark.createDataFrame([(there,), (there,), ("file:/gone.pdf",)], "path string")
    got = {r.path: (r.outcome, r.message) for r in files.requested(wanted, found).collect()}
    assert got == {there: ("accepted", None), "file:/gone.pdf": ("missing", "no such file: 'file:/gone.pdf'")}


def test_contents_are_read_only_if_selected(spark, tmp_path):
    put(tmp_path, "a.pdf")
    plan = files.scan(spark, str(tmp_path)).select("path", "outcome")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_stream_takes_each_file_once(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        q = files.scan_stream(spark, str(root), 2).select("path", "outcome").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None

    for i in range(5):
        put(root, f"{i}.pdf")
    run()
    put(root, "6.txt")
    run()
    run()
    got = spark.read.parquet(out).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("path").alias("d")).collect()
    assert sorted((r.outcome, r.n, r.d) for r in got) == [("accepted", 5, 5), ("refused", 1, 1)]
