"""The end of a log, from a bounded number of bytes."""

import json

import pytest

from dossierlake.sources import log_tail as L


def record(k, pad=""):
    return json.dumps({"seq": k, "hash": f"h{k}", "pad": pad})


def write(path, lines, ending="\n"):
    path.write_bytes(("\n".join(lines) + ending).encode())


@pytest.mark.parametrize("n", [0, 1, 3, 50, 5000])
@pytest.mark.parametrize("pad", [1, 300, 70_000])
def test_last_lines_equal_the_whole_file(tmp_path, n, pad):
    size = 2000 if pad < 1000 else 40
    lines = [record(k, "é" * (k * 37 % pad)) for k in range(size)]
    lines[size // 2 : size // 2] = ["", "   "]
    write(tmp_path / "log", lines)
    want = [x for x in lines if x.strip()][-n:] if n else []
    got, read = L.last_lines(str(tmp_path / "log"), n, most_bytes=1 << 30)
    assert [line.decode() for _, line in got] == want
    whole = (tmp_path / "log").read_bytes()
    assert all(whole[at : at + len(line)] == line for at, line in got)
    assert read <= sum(len(x.encode()) + 1 for x in want) + 3 * L.BLOCK + 2 * pad


def test_bytes_are_bounded(tmp_path):
    write(tmp_path / "log", [record(k, "x" * 100) for k in range(50_000)])
    got, read = L.last_lines(str(tmp_path / "log"), 20)
    assert len(got) == 20 and read == L.BLOCK < (tmp_path / "log").stat().st_size / 50
    got, read = L.last_lines(str(tmp_path / "log"), 10**9)
    assert read == L.MOST_BYTES and json.loads(got[-1][1])["seq"] == 49_999
    with pytest.raises(ValueError):
        L.last_lines(str(tmp_path / "log"), 10**9, fail_on_long=True)
    # A line that does not fit.
    write(tmp_path / "long", [record(1), record(2, "x" * 3_000_000)])
    assert L.last_lines(str(tmp_path / "long"), 2) == ([], L.MOST_BYTES)


def test_a_line_that_is_still_written(tmp_path):
    write(tmp_path / "log", [record(1), record(2), '{"seq": 3, "ha'], "")
    assert [json.loads(x)["seq"] for _, x in L.last_lines(str(tmp_path / "log"), 5)[0]] == [1, 2]
    write(tmp_path / "log", [record(1), record(2)], "")
    assert len(L.last_lines(str(tmp_path / "log"), 5)[0]) == 2
    (tmp_path / "empty").write_bytes(b"")
    assert L.last_lines(str(tmp_path / "empty"), 5) == ([], 0)


def test_source(spark, tmp_path):
    for f in range(3):
        write(tmp_path / f"log{f}", [record(100 * f + k) for k in range(100)])
    got = [json.loads(r.line)["seq"] for r in L.log_tail(spark, str(tmp_path), 2).orderBy("file", "position").collect()]
    assert got == [98, 99, 198, 199, 298, 299]
    assert tuple(L.log_head(spark, str(tmp_path)).first()) == (299, "h299")
    assert tuple(L.log_head(spark, str(tmp_path / "none")).first()) == (0, "0" * 64)


def test_stream_follows(spark, tmp_path):
    log, out, at = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "at")
    write(log, [record(1), record(2)])

    def run():
        L.log_follow(spark, str(log)).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(json.loads(r.line)["seq"] for r in spark.read.schema(L.SCHEMA).parquet(out).collect())

    assert run() == [1, 2]
    with log.open("a") as f:
        f.write(record(3) + "\n" + '{"seq": 4')
    assert run() == [1, 2, 3]
    with log.open("a") as f:
        f.write(', "hash": "h4"}\n')
    assert run() == [1, 2, 3, 4]
