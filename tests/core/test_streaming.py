from __future__ import annotations

import json

from parleylake.streaming import ingest


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_in_two_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    message = lambda i, minute=0, **x: {"id": i, "timestamp": f"2026-08-01T10:{minute:02d}:00+05:30", "sender": "a", "text": "hi"} | x
    run = lambda: ingest.write(ingest.read_messages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    lines(tmp_path / "in/1.json", [message("1"), message("2", 5), message("1"), message("3", text=" "), message("4", timestamp="2026-08-01T10:00:00"), message("5", message_type="pdf")])
    run()
    lines(tmp_path / "in/2.json", [message("2", 6), message("6", 7, text="[PDF] x")])
    run()
    good = {r["id"]: r["message_type"] for r in spark.read.parquet(f"{tmp_path}/out/good").collect()}
    refused = {r["id"]: list(r["problems"]) for r in spark.read.parquet(f"{tmp_path}/out/refused").collect()}
    assert good == {"1": "text", "2": "text", "6": "pdf"}
    assert refused["3"] == ["bad text"] and refused["5"] == ["type of text"] and refused.get("4", ["no instant"]) == ["no instant"]


def test_refused_messages_all_stay(spark, tmp_path):
    """Rows without an id don't count as repeats of each other, nor do broken lines."""
    (tmp_path / "in").mkdir()
    good = {"id": "1", "timestamp": "2026-08-01T10:00:00+05:30", "sender": "a", "text": "hi"}
    (tmp_path / "in/1.json").write_text("\n".join([json.dumps(good), json.dumps(good | {"id": None}), json.dumps(good | {"id": None, "text": "other"}), '{"broken', '{"broken too', json.dumps(good | {"id": "4", "timestamp": "2026-08-01T10:00:00"})]))
    ingest.write(ingest.read_messages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/out/good").collect()] == ["1"]
    refused = spark.read.parquet(f"{tmp_path}/out/refused").collect()
    assert len(refused) == 5 and sorted(r["text"] or "" for r in refused) == ["", "", "hi", "hi", "other"]
    assert [list(r["problems"]) for r in refused if r["id"] == "4"] == [["no instant"]]
