"""Logs that grow between micro-batches: every whole line comes once."""

import json
import random

import duckdb
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from passagework.sources import growing
from passagework.sources.growing import Range, last_line_end, lines_of
from passagework.sources.readers import ROUTING_SCHEMA
from passagework.streaming import live


def line(i, at, agent):
    return json.dumps({"event": "routing", "timestamp": at, "query": f"q{i} é", "selected_agent": agent})


def poll(stream, folder):
    """One run over what is there, from the checkpoint on."""
    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()


def test_appended_lines_come_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    one, two = logs / "routing.jsonl", logs / "other.jsonl"
    rows = [line(i, 1_700_000_000.0 + 600 * i, ["math", "code", None][i % 3]) for i in range(30)]
    stream = lambda: live.read_log_stream(spark, str(logs), ROUTING_SCHEMA).select("query", "ts", "selected_agent")
    one.write_text("\n".join(rows[:10]) + "\n\n{not json\n" + rows[10][:17])
    poll(stream(), tmp_path)
    read = lambda: sorted(r["query"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert read() == sorted(json.loads(r)["query"] for r in rows[:10])
    with one.open("a") as f:  # the half line's other half, and more of them
        f.write(rows[10][17:] + "\n" + "\n".join(rows[11:15]) + "\r\n" + rows[15])
    two.write_text(rows[20] + "\n")
    poll(stream(), tmp_path)
    assert read() == sorted(json.loads(r)["query"] for r in [*rows[:15], rows[20]])
    poll(stream(), tmp_path)  # nothing new
    with one.open("a") as f:
        f.write("\n" + "\n".join(rows[16:20]) + "\n")
    with two.open("a") as f:
        f.write("\n".join(rows[21:]) + "\n")
    poll(stream(), tmp_path)
    assert read() == sorted(json.loads(r)["query"] for r in rows)


def test_hourly_counts_of_a_growing_log(spark, tmp_path):
    log = tmp_path / "routing.jsonl"
    rng = random.Random(3)
    rows = [(i, 1_700_000_000.0 + rng.randrange(6 * 3600), rng.choice(["math", "code", None])) for i in range(200)]
    for part in range(4):
        with log.open("a") as f:
            f.writelines(line(*r) + "\n" for r in rows[50 * part : 50 * part + 50])
        counted = live.hourly_counts(live.read_log_stream(spark, str(log), ROUTING_SCHEMA), "1 day")
        out = live.run_available(counted, str(tmp_path / "hourly"), "complete")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    want = con.sql(f"SELECT epoch(date_trunc('hour', to_timestamp(timestamp)))::BIGINT, coalesce(selected_agent, 'fallback'), count(*) FROM read_json('{log}') GROUP BY ALL").fetchall()
    assert sorted(map(tuple, out.select(F.unix_timestamp("hour"), "agent", "n").collect())) == sorted(want)


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_ranges_share_out_the_lines(tmp_path, monkeypatch, step):
    """However a file is cut, each line is in one range, with its place; long lines span several."""
    rng = random.Random(step)
    lines = ["é" * rng.choice([0, 1, 5, 300]) + str(i) for i in range(100)]
    path = tmp_path / "a.log"
    path.write_bytes(("\n".join(lines) + "\nrest").encode())
    monkeypatch.setattr(growing, "STEP", 50)
    monkeypatch.setattr(growing, "TAIL", 3)
    system = fs.LocalFileSystem()
    end = last_line_end(system, str(path), path.stat().st_size)
    assert end == path.stat().st_size - 4
    reader = growing._Reader({"path": str(path), "bytesPerTask": str(step)})
    assert reader.latestOffset() == {str(path): end}
    found = [(p, x.decode()) for part in reader.partitions({}, {str(path): end}) for places, xs in lines_of(system, part) for p, x in zip(places, xs, strict=True)]
    assert [x for _, x in found] == lines
    data = path.read_bytes()
    assert all(data[p : p + len(x.encode())] == x.encode() for p, x in found)


def test_offsets_of_new_short_and_missing_files(tmp_path):
    reader = growing._Reader({"path": str(tmp_path / "none")})
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
    path = tmp_path / "a.log"
    path.write_bytes(b"no end of line yet")
    reader = growing._Reader({"path": str(tmp_path), "bytesPerTask": "100"})
    assert reader.latestOffset() == {}
    path.write_bytes(b"x\n" * 200)
    assert reader.partitions({}, reader.latestOffset()) == [Range(str(path), i, i + 100, i == 0) for i in range(0, 400, 100)]
    path.write_bytes(b"anew\n")
    assert reader.partitions({str(path): 400}, reader.latestOffset()) == [Range(str(path), 0, 5, True)]
    assert last_line_end(fs.LocalFileSystem(), str(path), 0) == 0
