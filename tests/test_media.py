import re
import struct

import pytest
from pyspark.sql import functions as F

from kindred.__main__ import main
from kindred.functions.tags import audio_tags, tags
from kindred.operators import video
from kindred.sources import documents


def frame(name, text, size=lambda n: struct.pack(">I", n)):
    body = b"\x03" + text.encode()
    return name.encode() + size(len(body)) + b"\0\0" + body


def test_tags(spark):
    frames = frame("TIT2", "Söng") + frame("TPE1", "A\0B") + frame("TRCK", "3/9")
    n = len(frames)
    v2 = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frames
    assert audio_tags(v2) == {"title": "Söng", "artist": "A, B", "track": "3/9"}
    v1 = b"x" * 50 + b"TAG" + b"Title".ljust(30, b"\0") + b"Me".ljust(30, b"\0") + b"".ljust(30, b"\0") + b"1999" + b"hi".ljust(28, b"\0") + b"\0\x07" + b"\x01"
    assert audio_tags(v1) == {"title": "Title", "artist": "Me", "year": "1999", "comment": "hi", "track": "7"}
    notes = [b"TITLE=T", b"ARTIST=a", b"ARTIST=b", b"X=y"]
    block = struct.pack("<I", 1) + b"v" + struct.pack("<I", 4) + b"".join(struct.pack("<I", len(c)) + c for c in notes)
    flac = b"fLaC" + bytes([0x84]) + len(block).to_bytes(3, "big") + block
    assert audio_tags(flac) == {"title": "T", "artist": "a, b"}
    df = spark.createDataFrame([(bytearray(flac),), (bytearray(b"ID3"),), (None,)], "c binary")
    assert sorted(len(r[0]) for r in df.select(tags(F.col("c"))).collect()) == [0, 0, 2]


PROBE = '{"format":{"duration":"10"},"streams":[{"codec_type":"video","codec_name":"h264","width":64,"height":48,"avg_frame_rate":"25/1"},{"codec_type":"audio","codec_name":"aac"}]}'


def test_analysis_by_decoders(spark):
    probe = PROBE

    def fake(command, deadline):
        if "broken" in " ".join(command):
            return "partial_tool_error", b"", b""
        if command[0] == "ffprobe":
            return "complete", probe.encode(), b""
        if command[0] == "fpcalc":
            return "partial_missing_tool", b"", b""
        return ("complete", b"", b"pts_time:4.0") if "showinfo" in " ".join(command) else ("complete", bytes(range(256)) * 4, b"")

    paths = spark.createDataFrame([("a",), ("broken",)], "path string")
    got = {r.path: r for r in video.analyze(paths, run=fake).collect()}
    assert got["a"].state == "partial_missing_tool" and len(got["a"].frames) >= 12 and got["a"].meta.width == 64 and got["a"].audio is None
    assert got["broken"].state == "partial_tool_error" and got["broken"].frames == []
    assert video.worst(["complete", "failed", "partial_timeout"]) == "failed"
    none = {r.state for r in video.raw_outputs(paths).collect()}
    assert none <= set(video.STATES)


def test_commands(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    for name, data in (("a.txt", "same"), ("b.txt", "same"), ("c.txt", "other")):
        (src / name).write_text(data)
    out = str(tmp_path / "out")
    assert main(["scan", str(src), "--out", out], spark) == 0
    assert main(["plan", f"{out}/groups", "--out", str(tmp_path / "plan")], spark) == 0
    plan = spark.read.json(str(tmp_path / "plan")).collect()
    assert len(plan) == 1 and plan[0].reference.endswith("a.txt")
    assert main(["query", f"{out}/groups", "--path", str(src / "b.txt")], spark) == 0
    assert "b.txt" in capsys.readouterr().out
    assert main(["groups", f"{out}/groups"], spark) == 0
    assert capsys.readouterr().out.count("sha256:") == 2
    assert main(["backup", f"{out}/groups", str(tmp_path / "copy")], spark) == 0
    assert documents.open_catalog(spark, str(tmp_path / "copy"), ["group_id", "path"]).count() == 2
    with pytest.raises(ValueError):
        documents.open_catalog(spark, str(tmp_path / "copy"), ["group_id", "colour"])
    spark.createDataFrame([("pending",), ("failed",), ("pending",)], "status string").write.parquet(str(tmp_path / "items"))
    capsys.readouterr()
    assert main(["status", str(tmp_path / "items")], spark) == 0
    assert re.search(r"2\|\s*0\|\s*0\|\s*1\|\s*3", capsys.readouterr().out)
    assert main(["doctor"], spark) == 0
