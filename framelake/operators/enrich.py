"""Batch encoding and enrichment jobs: what to do with each row, and the summary of what was done."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .joins import segment_for_frame

Encoder = Callable[[list], list]  # of texts or bytes; None for what can't be read


#: Letters whose runs have a table of 8 MB.
LETTERS = 128


def hash_encoder(dim: int = 64) -> Encoder:
    """A text encoder without training: every run of three letters adds +1 or -1 to one of dim places, which its digest
    picks, and the sums are scaled to length 1. Texts that share most of their runs have a cosine near 1. Bytes are
    taken as Latin-1 text; null or empty content can't be read."""
    places: dict[str, int] = {}
    letters = np.full(0x110000, -1, np.int32)  # numbers of the first LETTERS letters that are met
    known: list[int] = []
    runs = np.full(LETTERS**3, -1, np.int32)  # places of their runs

    def place(gram: str) -> int:
        """Twice the place, and 1 more for +1."""
        if gram not in places:
            if len(places) > 1 << 20:
                places.clear()
            h = int.from_bytes(hashlib.sha256(gram.encode("utf-8", "surrogatepass")).digest()[:8], "little")
            places[gram] = (h >> 1) % dim * 2 + (h & 1)
        return places[gram]

    def placed(text: str) -> np.ndarray:
        """The place of every run of a text: by a table, or one by one for runs with letters that have no number."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        number = letters[code]
        if (number < 0).any() and len(known) < LETTERS:
            new = np.unique(code[number < 0])[: LETTERS - len(known)]
            letters[new] = np.arange(len(known), len(known) + len(new))
            known.extend(new.tolist())
            number = letters[code]
        at = (number[:-2] * LETTERS + number[1:-1]) * LETTERS + number[2:]
        other = np.flatnonzero((number[:-2] < 0) | (number[1:-1] < 0) | (number[2:] < 0))
        at[other] = 0
        found = runs[at]
        for i in np.unique(at[found < 0]).tolist():
            runs[i] = place("".join(chr(known[n]) for n in (i // LETTERS**2, i // LETTERS % LETTERS, i % LETTERS)))
        found = runs[at]
        found[other] = [place(text[i : i + 3]) for i in other.tolist()]
        return found

    def encode(items: list) -> list:
        out = []
        for x in items:
            text = x.decode("latin-1") if isinstance(x, (bytes, bytearray)) else x
            if not text:
                out.append(None)
                continue
            found = placed(f" {text} ")
            v = np.bincount(found >> 1, np.where(found & 1, 1.0, -1.0), dim)
            out.append(v / max(float(np.linalg.norm(v)), 1e-12))
        return out

    return encode


def batch_encode(rows: DataFrame, key: str, content: str, make: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """(key, vector): make() loads the model once in each task. Rows that can't be read are left out, never filled with
    zeros, and the others keep their keys."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                made = [(k, np.asarray(v, np.float32)) for k, v in zip(part[key], encode(part[content].tolist()), strict=True) if v is not None]
                yield pd.DataFrame(made, columns=[key, "vector"])

    return rows.select(key, content).mapInPandas(run, f"{key} {kind}, vector array<float>")


def encode_once(asked: DataFrame, cache: DataFrame, make: Callable[[], Encoder], as_of: Column, ttl_days: int = 7) -> DataFrame:
    """The cache after the batch: live rows (key, vector, cached_at), and rows for keys that had none. asked: (key, content)."""
    live = cache.where(F.col("cached_at") > as_of - F.expr(f"INTERVAL {ttl_days} DAYS"))
    new = asked.groupBy("key").agg(F.min("content").alias("content")).join(live.select("key"), "key", "left_anti")
    return live.unionByName(batch_encode(new, "key", "content", make).withColumn("cached_at", as_of))


def caption_decisions(frames: DataFrame, existing: DataFrame) -> DataFrame:
    """action for each video frame without a caption: failed (no file hash or index), skipped (its image is gone) or
    processed. existing: (id) of frames whose image is there."""
    there = existing.select("id").distinct().withColumn("__there", F.lit(True))
    todo = frames.where("file_type = 'video' AND caption IS NULL").join(there, "id", "left")
    action = F.when(F.col("file_hash").isNull() | F.col("frame_index").isNull(), "failed").when(F.col("__there").isNull(), "skipped").otherwise("processed")
    return todo.withColumn("action", action).drop("__there")


def caption_text(caption: Column) -> Column:
    return F.when(F.coalesce(caption, F.lit("")) == "", "[no description]").otherwise(caption)


def segment_backfill(frames: DataFrame, segments: DataFrame, method: str = "vad_two_pass") -> DataFrame:
    """(id, segment_index, action): files whose first frame has the method already are skipped whole."""
    gate = frames.groupBy("file_path").agg(F.min_by("method", "id").alias("first_method"))
    marked = frames.join(gate, "file_path").withColumn("action", F.when(F.col("first_method") == method, "skipped").otherwise("processed"))
    todo = marked.where("action = 'processed'")
    return todo.join(segment_for_frame(todo, segments), "id").select("id", "segment_index", "action").unionByName(marked.where("action = 'skipped'").select("id", F.lit(None).cast("int").alias("segment_index"), "action"))


def file_feature_backfill(frames: DataFrame, features: DataFrame, as_of: Column) -> DataFrame:
    """Features computed once for each file, on all its frames that lack them; no audio gives has_speech false and energy 0."""
    done = F.col("has_speech").isNotNull()
    joined = frames.join(features.select("file_path", F.col("has_speech").alias("__speech"), F.col("energy").alias("__energy")), "file_path", "left")
    return joined.select("id", "file_path", F.when(done, F.col("has_speech")).otherwise(F.coalesce("__speech", F.lit(False))).alias("has_speech"), F.when(done, F.col("energy")).otherwise(F.coalesce("__energy", F.lit(0.0))).alias("energy"), F.when(done, F.col("updated_at")).otherwise(as_of).alias("updated_at"))


def detection_targets(frames: DataFrame, path_text: str) -> DataFrame:
    """Frames under a path text, without labels, that have a hash and an index."""
    return frames.where(F.col("file_path").contains(path_text) & (F.col("yolo_labels").isNull() | (F.size("yolo_labels") == 0)) & F.col("file_hash").isNotNull() & F.col("frame_index").isNotNull())


def detection_rollup(detections: Column, confidence: float = 0.25) -> Column:
    """Struct of sorted distinct labels and the number of detections at or above the confidence."""
    kept = F.filter(detections, lambda d: d["confidence"] >= confidence)
    return F.struct(F.array_sort(F.array_distinct(F.transform(kept, lambda d: d["label"]))).alias("labels"), F.size(kept).alias("n"))


def reset_status(files: DataFrame, as_of: Column, pattern: str | None = None, stuck_hours: int = 2) -> DataFrame:
    """Errors whose message matches the pattern, and rows that have been processing too long, back to pending."""
    failed = (F.col("status") == "error") & (F.col("error_message").like(pattern) if pattern else F.lit(True))
    stuck = (F.col("status") == "processing") & (F.col("created_at") < as_of - F.expr(f"INTERVAL {stuck_hours} HOURS"))
    hit = F.coalesce(failed, F.lit(False)) | F.coalesce(stuck, F.lit(False))
    return files.withColumns({"error_message": F.when(~hit, F.col("error_message")), "status": F.when(hit, "pending").otherwise(F.col("status"))})


def default_version(files: DataFrame, version: str = "pre-tracking") -> DataFrame:
    return files.withColumn("model_version", F.when((F.col("status") == "done") & F.col("model_version").isNull(), version).otherwise(F.col("model_version")))


def summary(decided: DataFrame, action: str = "action") -> DataFrame:
    count = lambda name: F.count_if(F.col(action) == name).alias(name)
    return decided.agg(F.count("*").alias("total"), count("processed"), count("skipped"), count("failed"))


def run_steps(
    df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], error_col: str = "error", settle: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Steps in turn over the rows without an error; a row that a step marks passes the later ones by.

    With settle, which writes a DataFrame and reads it back, each step's rows are worked out before the next step, so the
    seconds beside each name are those that the step ran, and a later failure does not repeat it. Without it all steps
    make one plan, and the seconds are only what declaring them took."""
    if error_col not in df.columns:
        df = df.withColumn(error_col, F.lit(None).cast("string"))
    failed, took = None, []
    for name, step in steps:
        began = time.perf_counter()
        bad = df.where(F.col(error_col).isNotNull())
        failed = bad if failed is None else failed.unionByName(bad, allowMissingColumns=True)
        df = step(df.where(F.col(error_col).isNull()))
        df = settle(df) if settle else df
        took.append((name, time.perf_counter() - began))
    return (df if failed is None else df.unionByName(failed, allowMissingColumns=True)), took


@dataclass(frozen=True)
class StepMetrics:
    """What one step's run itself told: its rows, those that it marked as failed, and the seconds it took."""

    name: str
    rows: int
    failed: int
    seconds: float


def run_observed_steps(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], settle: Callable[[DataFrame], DataFrame], error_col: str = "error") -> tuple[DataFrame, list[StepMetrics]]:
    """As run_steps, with metrics of every step. They are observed on the rows as the step's one run writes them, so the
    data is passed once, and nothing is counted again; seconds are those of that run. A step that no row reaches has zeros."""
    if error_col not in df.columns:
        df = df.withColumn(error_col, F.lit(None).cast("string"))
    failed: list[DataFrame] = []
    told: list[StepMetrics] = []
    for name, step in steps:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        made = step(df.where(F.col(error_col).isNull()))
        began = time.perf_counter()
        done = settle(made.observe(seen, F.count("*").alias("rows"), F.count_if(F.col(error_col).isNotNull()).alias("failed")))
        seconds = time.perf_counter() - began
        told.append(StepMetrics(name, seen.get.get("rows") or 0, seen.get.get("failed") or 0, seconds))
        failed.append(done.where(F.col(error_col).isNotNull()))
        df = done.where(F.col(error_col).isNull())
    for bad in failed:
        df = df.unionByName(bad, allowMissingColumns=True)
    return df, told


def backfill_summary(told: list[StepMetrics], skipped: int = 0) -> dict[str, int]:
    """Totals as a backfill reports them: rows of the first step and those skipped before it, processed to the end, failed."""
    failed = sum(t.failed for t in told)
    total = told[0].rows if told else 0
    return {"total": total + skipped, "processed": total - failed, "skipped": skipped, "failed": failed}
