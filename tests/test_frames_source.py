"""The data source of frames: ranges, growing files, torn frames, and a stream that resumes at its offset."""

import random

import pytest

from gaugeline.sources import frames_source


def frame(k):
    return f"event: tick\ndata: {{\"step\": {k}, \"x\": \"{'y' * (k % 50)}é\"}}\n\n".encode()


@pytest.mark.parametrize("size", [7, 60, 1000, 1 << 26])
def test_ranges_read_each_frame_once(spark, tmp_path, size):
    frames_source.register(spark)
    for n in (0, 1, 40):
        (tmp_path / f"f{n}.sse").write_bytes(b"".join(frame(k) for k in range(n)) + b": torn\ndata: no")
    (tmp_path / "odd.sse").write_bytes(b": only a comment\n\ndata: a\ndata: b\n\nevent: end\ndata:\n\n\n\n")
    got = sorted(map(tuple, spark.read.format("frames").option("path", str(tmp_path)).option("range", size).load().collect()))
    want, at = [], 0
    for k in range(40):
        want.append(("f40.sse", at, "tick", frame(k).decode()[17:-2].removeprefix(" ")))
        at += len(frame(k))
    assert [r for r in got if r[0] == "f40.sse"] == want
    assert [r[1:] for r in got if r[0] == "f1.sse"] == [want[0][1:]]
    assert [r[2:] for r in got if r[0] == "odd.sse"] == [("message", "a\nb"), ("end", "")]


def test_stream_resumes_and_waits_for_whole_frames(spark, tmp_path):
    frames_source.register(spark)
    rnd = random.Random(4)
    whole = b"".join(frame(k) for k in range(30))
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def drained():
        q = spark.readStream.format("frames").option("path", f"file://{tmp_path}/in").option("range", 200).load()
        q.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return [r["at"] for r in spark.read.parquet(out).orderBy("at").collect()]

    starts = [sum(len(frame(j)) for j in range(k)) for k in range(31)]
    at = 0
    for _ in range(4):
        at = min(len(whole), at + rnd.randint(150, 700))
        (tmp_path / "in" / "a.sse").write_bytes(whole[:at])  # most often torn
        assert drained() == [s for s, e in zip(starts, starts[1:]) if e <= at]
    (tmp_path / "in" / "a.sse").write_bytes(whole)
    assert drained() == drained() == starts[:-1]


def test_an_empty_folder(spark, tmp_path):
    frames_source.register(spark)
    assert spark.read.format("frames").option("path", str(tmp_path)).load().count() == 0
