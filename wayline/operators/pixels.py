"""Image quality and redaction on pixel arrays: Arrow batches of encoded bytes, numpy inside."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityConfig:
    blur_reject: float = 40.0
    blur_degrade: float = 100.0
    dark_reject: float = 25.0
    dark_degrade: float = 50.0
    bright_degrade: float = 210.0
    bright_reject: float = 235.0


def luma(pixels: np.ndarray) -> np.ndarray:
    """Rec. 601 luma of an RGB image, a grey one as it is."""
    p = pixels.astype(np.float64)
    return p if p.ndim == 2 else p[..., 0] * 0.299 + p[..., 1] * 0.587 + p[..., 2] * 0.114


def blur_score(grey: np.ndarray) -> float | None:
    """Variance of the Laplacian over inner pixels; None below 3 pixels a side."""
    if min(grey.shape) < 3:
        return None
    lap = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4.0 * grey[1:-1, 1:-1]
    return float(lap.var())


def score_images(images: DataFrame) -> DataFrame:
    """(image_id, blur, brightness) of raw images (image_id, data binary, height, width, channels in RGB order); nulls
    where there are no pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.data is None or not len(r.data):
                    out.append((r.image_id, None, None))
                    continue
                g = luma(np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels)).squeeze())
                b = blur_score(g)
                out.append((r.image_id, None if b is None else round(b, 3), round(float(g.mean()), 3)))
            yield pd.DataFrame(out, columns=["image_id", "blur", "brightness"])

    return images.select("image_id", "data", "height", "width", "channels").mapInPandas(run, "image_id string, blur double, brightness double")


def from_spark_images(images: DataFrame) -> DataFrame:
    """What spark.read.format('image') gives, as raw images; its bytes are BGR and become RGB here."""

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).reshape(-1, c)[:, : min(c, 3)][:, ::-1].tobytes() for d, c in zip(data, channels)])

    i = "image."
    return images.select(F.col(i + "origin").alias("image_id"), rgb(i + "data", i + "nChannels").alias("data"), F.col(i + "height").alias("height"), F.col(i + "width").alias("width"), F.least(F.col(i + "nChannels"), F.lit(3)).alias("channels"))


def verdict(blur: Column, brightness: Column, c: QualityConfig = QualityConfig()) -> Column:
    """struct(quality, reasons): rejected beats degraded; without scores a frame is accepted."""
    why = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    reject = F.array_compact(F.array(why(blur < c.blur_reject, "too_blurred"), why(brightness < c.dark_reject, "too_dark"), why(brightness > c.bright_reject, "too_bright")))
    degrade = F.array_compact(F.array(why((blur >= c.blur_reject) & (blur < c.blur_degrade), "blurred"), why((brightness >= c.dark_reject) & (brightness < c.dark_degrade), "dark"), why((brightness <= c.bright_reject) & (brightness > c.bright_degrade), "bright")))
    return F.struct(F.when(F.size(reject) > 0, "rejected").when(F.size(degrade) > 0, "degraded").otherwise("accepted").alias("quality"), F.concat(reject, degrade).alias("reasons"))


@dataclass(frozen=True)
class RedactionConfig:
    method: str = "mosaic"
    blocks_across: int = 4
    min_block_px: int = 8
    margin: float = 0.15
    solid: tuple[int, int, int] = (16, 16, 16)


def mosaic(patch: np.ndarray, block: int) -> np.ndarray:
    h, w = patch.shape[:2]
    pad = [(0, -h % block), (0, -w % block)] + [(0, 0)] * (patch.ndim - 2)
    p = np.pad(patch, pad, mode="edge").astype(np.float64)
    means = p.reshape(p.shape[0] // block, block, p.shape[1] // block, block, *p.shape[2:]).mean(axis=(1, 3)).astype(np.uint8)
    return np.repeat(np.repeat(means, block, 0), block, 1)[:h, :w]


def redact(pixels: np.ndarray, regions: list[tuple[float, float, float, float]], c: RedactionConfig = RedactionConfig()) -> np.ndarray:
    """A copy in which each region, grown by the margin, is blocked out."""
    out = pixels.copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2 in regions:
        mx, my = (x2 - x1) * c.margin, (y2 - y1) * c.margin
        a, b = int(max(0.0, x1 - mx)), int(max(0.0, y1 - my))
        e, f = int(round(min(w, x2 + mx))), int(round(min(h, y2 + my)))
        if e <= a or f <= b:
            continue
        if c.method == "solid":
            out[b:f, a:e] = c.solid
        else:
            out[b:f, a:e] = mosaic(out[b:f, a:e], max(c.min_block_px, -(-min(e - a, f - b) // c.blocks_across)))
    return out


def annotate(pixels: np.ndarray, boxes: list[tuple[float, float, float, float]], colour: tuple[int, int, int] = (220, 30, 30), width: int = 3) -> np.ndarray:
    """A copy with the outlines of boxes."""
    out = pixels.copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2 in boxes:
        a, b, e, f = int(max(0, x1)), int(max(0, y1)), int(min(w, x2)), int(min(h, y2))
        if e <= a or f <= b:
            continue
        out[b : b + width, a:e] = out[max(b, f - width) : f, a:e] = colour
        out[b:f, a : a + width] = out[b:f, max(a, e - width) : e] = colour
    return out


EVIDENCE = "defect_id string, kind string, data binary, height int, width int, channels int"


def evidence(images: DataFrame, boxes: DataFrame, regions: DataFrame, config: RedactionConfig = RedactionConfig()) -> DataFrame:
    """EVIDENCE: for each defect of `boxes` (defect_id, image_id, x1..y2 and crop_x1..crop_y2 of its own best box) the
    frame, the frame with its box, and the crop around it. An image is redacted once, as a whole, before anything is
    derived from it, so a region that reaches over a crop's edge is blocked out in the crop too."""
    rows = redact_images(images, regions, config).join(boxes.withColumnsRenamed({c: f"b_{c}" for c in ("x1", "y1", "x2", "y2")}), "image_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                p = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
                for kind, q in (("frame", p), ("context", annotate(p, [(r.b_x1, r.b_y1, r.b_x2, r.b_y2)])), ("crop", p[int(r.crop_y1) : int(r.crop_y2), int(r.crop_x1) : int(r.crop_x2)])):
                    out.append((r.defect_id, kind, q.tobytes(), q.shape[0], q.shape[1], q.shape[2]))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in EVIDENCE.split(", ")])

    return rows.mapInPandas(run, EVIDENCE)


def redact_images(images: DataFrame, regions: DataFrame, config: RedactionConfig = RedactionConfig()) -> DataFrame:
    """images with their regions (image_id, x1, y1, x2, y2) blocked out. An image whose pixels can't be read fails the
    job: nothing leaves unredacted."""
    own = regions.groupBy("image_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("regions"))
    rows = images.join(own, "image_id", "left").select("image_id", "data", "height", "width", "channels", "regions")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            done = []
            for r in pdf.itertuples(index=False):
                p = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
                boxes = [] if r.regions is None else [(q["x1"], q["y1"], q["x2"], q["y2"]) for q in r.regions]
                done.append(redact(p, boxes, config).tobytes())
            pdf["data"] = done
            yield pdf.drop(columns="regions")

    return rows.mapInPandas(run, "image_id string, data binary, height int, width int, channels int")
