"""A sink that leaves whole results or none: repeated attempts, a task that dies, a target that can't be written."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versewright.sinks import committed as C


def there(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def batch(rows):
    return pa.RecordBatch.from_pydict({"path": [p for p, _ in rows], "content": pa.array([c for _, c in rows], pa.binary())})


def test_repeated_and_failed_attempts(tmp_path):
    w = C.Writer({"path": str(tmp_path / "out")})

    def dies():
        yield batch([("a/1.txt", b"half"), ("a/9.txt", b"never")])
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        w.write(dies())
    again = w.write(iter([batch([("a/1.txt", b"one"), ("b.txt", b"")])]))
    w.write(iter([batch([("a/1.txt", b"speculative"), ("c.txt", b"x")])]))  # its message never comes
    assert not os.path.exists(tmp_path / "out/a")
    w.commit([again, None])
    assert there(tmp_path / "out") == {"a/1.txt": b"one", "b.txt": b""} and os.listdir(tmp_path / "out") != [] and not os.path.exists(tmp_path / "out" / C.STAGING)


def test_abort_leaves_nothing(tmp_path):
    w = C.Writer({"path": str(tmp_path)})
    m = w.write(iter([batch([("x.txt", b"1")])]))
    w.abort([m])
    assert there(tmp_path) == {} and os.listdir(tmp_path) == []


@pytest.mark.parametrize("path", ["../x", "/etc/x", "a/../../x", "", None, ".", "_staging/x"])
def test_paths_stay_inside(tmp_path, path):
    with pytest.raises(ValueError):
        C.Writer({"path": str(tmp_path)}).write(iter([batch([(path, b"x")])]))


def test_recovery_folder(tmp_path):
    w = C.Writer({"path": str(tmp_path / "out"), "recovery": str(tmp_path / "kept")})
    m = w.write(iter([batch([("0.txt", b"first"), ("a/1.txt", b"one"), ("b.txt", b"two")])]))
    (tmp_path / "out" / "a").write_bytes(b"a file where a folder should be")
    w.commit([m])
    assert there(tmp_path / "kept") == {"0.txt": b"first", "a/1.txt": b"one", "b.txt": b"two"} and there(tmp_path / "out") == {"a": b"a file where a folder should be"}
    w = C.Writer({"path": str(tmp_path / "out")})
    m = w.write(iter([batch([("a/1.txt", b"one")])]))
    with pytest.raises(OSError):
        w.commit([m])


def test_through_spark(spark, tmp_path):
    spark.dataSource.register(C.CommittedFiles)
    d = spark.range(50).select(F.concat(F.lit("p"), F.col("id") % 5, F.lit("/"), "id", F.lit(".txt")).alias("path"), F.concat(F.lit("text é "), "id").alias("content")).repartition(7)
    d.write.format("committed_files").mode("append").save(f"file://{tmp_path}/out")
    assert there(tmp_path / "out") == {f"p{i % 5}/{i}.txt": f"text é {i}".encode() for i in range(50)}
    bad = d.withColumn("content", F.when(F.col("path") == "p3/33.txt", F.raise_error(F.lit("dies"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="dies"):
        bad.write.format("committed_files").mode("append").save(f"file://{tmp_path}/other")
    assert not [f for f in there(tmp_path / "other") if not f.startswith(C.STAGING)]  # tasks that outlive the abort may still be staging
