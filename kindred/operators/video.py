"""Analysis of video files by external decoders, where executors have them."""

import shutil
import subprocess
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.functions.bits import _signed, dct_phash_of
from kindred.functions.media import audio_command, audio_words, frame_command, parse_probe, probe_command, scene_command, scene_times
from kindred.operators.sequence import frame_plan

#: States of an analysis, the later ones outweighing the earlier.
STATES = ("complete", "partial_missing_tool", "partial_tool_error", "partial_resource_limit", "partial_timeout", "partial_cancelled", "failed")
SCENE_THRESHOLD, FRAME, AUDIO_SECONDS, MOST_OUTPUT = 0.35, 32, 600, 4 << 20


def worst(states: list[str]) -> str:
    return max(states, key=STATES.index, default="complete")


def _run(command: list[str], deadline: float) -> tuple[str, bytes, bytes]:
    left = deadline - time.monotonic()
    if left <= 0:
        return "partial_timeout", b"", b""
    if shutil.which(command[0]) is None:
        return "partial_missing_tool", b"", b""
    try:
        done = subprocess.run(command, capture_output=True, timeout=left, check=False, stdin=subprocess.DEVNULL)
    except subprocess.TimeoutExpired:
        return "partial_timeout", b"", b""
    state = "partial_tool_error" if done.returncode else "partial_resource_limit" if len(done.stdout) > MOST_OUTPUT else "complete"
    return state, done.stdout[:MOST_OUTPUT], done.stderr[:MOST_OUTPUT]


def raw_outputs(paths: DataFrame, seconds: float = 120.0, run=_run) -> DataFrame:
    """(path, probe, scenes, audio, states): what the decoders say of files (path) that every executor mounts, within ``seconds`` each.

    Audio is only fingerprinted where nothing ended the analysis before; a missing decoder or a
    timeout is a state, never an error of the job.
    """
    def each(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                deadline = time.monotonic() + seconds
                state, probe, _ = run(probe_command("ffprobe", path), deadline)
                states, scenes, audio = [state], b"", b""
                if state == "complete":
                    state, _, scenes = run(scene_command("ffmpeg", path, SCENE_THRESHOLD), deadline)
                    states.append(state)
                    if STATES.index(worst(states)) < STATES.index("partial_timeout"):
                        state, audio, _ = run(audio_command("fpcalc", path, AUDIO_SECONDS), deadline)
                        states.append(state)
                rows.append((path, *(x.decode("utf-8", "replace") for x in (probe, scenes, audio)), worst(states)))
            names = ["path", "probe", "scenes", "audio", "state"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], names=names)

    return paths.select("path").mapInArrow(each, "path string, probe string, scenes string, audio string, state string")


def frames(plans: DataFrame, seconds: float = 120.0, run=_run) -> DataFrame:
    """(path, frames): pHashes of the gray frames at the planned times of files (path, duration, scenes)."""
    def each(batches):
        for b in batches:
            paths, out = b.column(0).to_pylist(), []
            for path, duration, cuts in zip(paths, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                deadline, found = time.monotonic() + seconds, []
                for t in frame_plan(duration, cuts or []) if duration else []:
                    state, px, _ = run(frame_command("ffmpeg", path, t, FRAME, FRAME), deadline)
                    if state == "complete" and len(px) == FRAME * FRAME:
                        found.append(_signed(dct_phash_of(np.frombuffer(px, np.uint8).reshape(FRAME, FRAME))))
                out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.list_(pa.int64()))], names=["path", "frames"])

    return plans.select("path", "duration", "scenes").mapInArrow(each, "path string, frames array<long>")


def analyze(paths: DataFrame, before: DataFrame | None = None, run=_run) -> DataFrame:
    """(path, meta, frames, audio, state) of files; failed where a later listing (``before``: path, size, mtime_ns and size_now, mtime_now) shows another file."""
    raw = raw_outputs(paths, run=run).withColumn("meta", parse_probe(F.col("probe")))
    plans = raw.withColumn("duration", F.col("meta.duration_seconds")).withColumn("cuts", scene_times(F.col("scenes"), F.col("meta.duration_seconds")))
    shots = frames(plans.select("path", "duration", F.col("cuts").alias("scenes")), run=run)
    out = plans.join(shots, "path").select("path", "meta", "frames", audio_words(F.col("audio")).alias("audio"), F.when(F.col("meta").isNull() & (F.col("state") == "complete"), "failed").when((F.size("frames") == 0) & (F.col("state") == "complete"), "partial_tool_error").otherwise(F.col("state")).alias("state"))
    if before is not None:
        changed = before.where((F.col("size") != F.col("size_now")) | (F.col("mtime_ns") != F.col("mtime_now"))).select("path", F.lit(True).alias("_c"))
        out = out.join(changed, "path", "left").withColumn("state", F.when(F.col("_c"), "failed").otherwise(F.col("state"))).drop("_c")
    return out


def capabilities(spark: SparkSession) -> DataFrame:
    """Decoders of the machine that asks."""
    return spark.createDataFrame([(t, shutil.which(t) is not None) for t in ("ffprobe", "ffmpeg", "fpcalc")], "tool string, available boolean")
