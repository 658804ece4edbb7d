"""Streaming twins: incremental association and track health."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sceneloom.operators.matching import BOX, AssociationConfig, TrackBook

OUT = "clip long, detection_id long, frame int, track_id string, code string"
STATE = "tracks string, counters string, frame int, late long"


def _walk(config: AssociationConfig) -> Callable:
    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracks, counters, last, late = state.get if state.exists else ("{}", "{}", -1, 0)
        book = TrackBook(config, json.loads(tracks), json.loads(counters))
        rows = pd.concat(list(parts)).sort_values(["frame", "detection_id"])
        out = []
        for frame, group in rows.groupby("frame"):
            detections = [{**r, "id": r["detection_id"], "frame": int(frame)} for r in group[["detection_id", "label", *BOX]].to_dict("records")]
            if frame <= last:  # emitted tracks are never revised
                late += len(detections)
                out += [(key[0], d["id"], int(frame), None, "late") for d in detections]
                continue
            out += [(key[0], ident, int(frame), name, code) for ident, name, code, _, _ in book.frame(int(frame), detections)]
            last = int(frame)
        kept = {k: {c: v[c] for c in ("label", "frame", *BOX)} for k, v in book.tracks.items()}
        state.update((json.dumps(kept, default=float), json.dumps(book.counters), last, late))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1000 * 3600 * (config.max_frame_gap + 1))
        yield pd.DataFrame(out, columns=["clip", "detection_id", "frame", "track_id", "code"])

    return step


def associate_stream(detections: DataFrame, time: str = "ts", delay: str = "2 hours", config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """Detections with their tracks, batch by batch: ``(clip, detection_id, frame, label, score, x1.., ts)``.

    A clip's active tracks are its state; it goes when the watermark has passed the frame gap. Frames at or before the clip's last
    one come too late to change tracks: they are returned with code ``late`` and counted in the state.
    """
    return detections.withWatermark(time, delay).groupBy("clip").applyInPandasWithState(_walk(config), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def track_health(observations: DataFrame, time: str = "ts", delay: str = "1 hour", every: str = "1 day", keys: tuple[str, ...] = ("clip", "instance")) -> DataFrame:
    """Observations of each track by tumbling window; works on streams and tables."""
    rows = observations.withWatermark(time, delay) if observations.isStreaming else observations
    out = rows.groupBy(F.window(time, every), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "mean_x")


def track_sessions(observations: DataFrame, time: str = "ts", delay: str = "1 hour", gap: str = "12 hours", keys: tuple[str, ...] = ("clip", "instance")) -> DataFrame:
    """Unbroken stretches of each track: a silence of ``gap`` is a track break."""
    rows = observations.withWatermark(time, delay) if observations.isStreaming else observations
    out = rows.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote below ``path``."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A Parquet table as a stream of its files. A table of one file is named by a pattern, as a stream's source is a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path if folder else f"{path}*")
