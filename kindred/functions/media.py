"""Probe output of media tools and numbers of metadata."""

import json
import math
import re

from pyspark.sql import Column, functions as F

PROBE = "struct<format:struct<format_name:string,duration:string,bit_rate:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,duration:string,avg_frame_rate:string,r_frame_rate:string>>>"


def rate(text: Column) -> Column:
    """A14: "30000/1001" as a number; null for anything that isn't finite and positive."""
    parts = F.split(text, "/")
    value = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"))
    return F.when((value > 0) & (value < float("inf")), value)


def finite(text: Column, least: float = 0.0) -> Column:
    """A finite number above ``least``, else null."""
    value = text.cast("string").try_cast("double")
    return F.when((value > least) & (value < float("inf")), value)


def parse_probe(payload: Column) -> Column:
    """Metadata of the first video and audio stream; null without a usable video stream."""
    p = F.from_json(payload, PROBE)
    stream = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = stream("video"), stream("audio")
    duration = F.coalesce(finite(v["duration"]), finite(p["format"]["duration"]))
    fps = F.coalesce(rate(v["avg_frame_rate"]), rate(v["r_frame_rate"]))
    ok = duration.isNotNull() & (v["width"] > 0) & (v["height"] > 0) & fps.isNotNull() & v["codec_name"].isNotNull()
    return F.when(
        ok,
        F.struct(
            duration.alias("duration_seconds"), v["width"].alias("width"), v["height"].alias("height"), fps.alias("frame_rate"), v["codec_name"].alias("video_codec"), v["pix_fmt"].alias("pixel_format"),
            a["codec_name"].alias("audio_codec"), finite(a["duration"]).alias("audio_duration_seconds"), p["format"]["bit_rate"].try_cast("long").alias("bit_rate"), p["format"]["format_name"].alias("container"),
        ),
    )


def scene_times(log: Column, duration: Column) -> Column:
    """Sorted distinct times within the video."""
    times = F.transform(F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda t: t.cast("double"))
    return F.array_sort(F.array_distinct(F.filter(times, lambda t: (t >= 0) & (t <= duration))))


def audio_words(payload: Column, most: int = 16384) -> Column:
    """Words of an audio fingerprint given as text or as an array, as 0 .. 2**32 - 1; null for more than ``most`` or none."""
    as_list = F.from_json(payload, "struct<fingerprint:array<long>>")["fingerprint"]
    as_text = F.transform(F.split(F.from_json(payload, "struct<fingerprint:string>")["fingerprint"], ","), lambda x: F.trim(x).try_cast("long"))
    values = F.transform(F.coalesce(as_list, as_text), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))
    bad = (F.size(values) > most) | (F.size(values) < 1) | F.exists(values, lambda x: x.isNull())
    return F.when(~F.coalesce(bad, F.lit(True)), values)


def aspect_ratio(width: Column, height: Column) -> Column:
    """C31."""
    return width / height


def aspect_bucket(aspect: Column, step: float = 0.025) -> Column:
    """C32."""
    return F.bround(F.ln(aspect) / math.log1p(step)).cast("int")


def duration_bucket(duration: Column) -> Column:
    return F.floor(F.ln(duration) / math.log(1.25)).cast("int")


def bit_depth(mode: Column, bits: Column | None = None, other: int = 0) -> Column:
    """Explicit bits, else those of the pixel mode, else ``other`` (8 where pictures are ranked, C29)."""
    table = F.when(mode == "1", 1).when(mode.startswith("I;16"), 16).when(mode.isin("I", "F"), 32).when(mode.isin("L", "P", "RGB", "RGBA", "CMYK", "YCbCr", "LA", "PA", "HSV", "LAB"), 8).otherwise(other)
    return table if bits is None else F.coalesce(bits, table)


def probe_command(program: str, path: str) -> list[str]:
    """What asks a decoder for a file's streams, where an executor has one."""
    return [program, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path]


def scene_command(program: str, path: str, threshold: float) -> list[str]:
    """For the times of scene cuts."""
    return [program, "-nostdin", "-i", path, "-vf", f"select='gt(scene,{threshold})',showinfo", "-an", "-f", "null", "-"]


def frame_command(program: str, path: str, at: float, width: int = 32, height: int = 32) -> list[str]:
    """For one gray frame."""
    return [program, "-nostdin", "-ss", f"{at:.6f}", "-i", path, "-frames:v", "1", "-vf", f"scale={width}:{height}", "-pix_fmt", "gray", "-f", "rawvideo", "-"]


def audio_command(program: str, path: str, seconds: int) -> list[str]:
    """For an audio fingerprint."""
    return [program, "-raw", "-json", "-length", str(seconds), path]


def strict_json(text: str, most_depth: int = 64, most_nodes: int = 1_000_000):
    """JSON without repeated keys, NaN or infinities, within limits of depth and size; ValueError otherwise."""
    nodes = 0

    def pairs(items):
        nonlocal nodes
        nodes += len(items)
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        if nodes > most_nodes:
            raise ValueError("too many nodes")
        return dict(items)

    def refuse(name):
        raise ValueError(f"{name} isn't JSON")

    depth = deepest = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text):
        depth += (c in "[{") - (c in "]}")
        deepest = max(deepest, depth)
    if deepest > most_depth:
        raise ValueError("nested too deep")
    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
