"""Image transform geometry (F9) and the checks around it (P3-P5).  Only
sizes and offsets are planned here; pixel resampling is a per-row codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions.util import col

MODES = ("scale", "center-crop", "center-crop-wide", "center-crop-dhariwal")


def _lit_or_col(v) -> Column:
    if v is None:
        return F.lit(None).cast("long")
    return F.lit(v).cast("long") if isinstance(v, int) else col(v).cast("long")


def crop_plan(w, h, mode: str, width=None, height=None) -> Column:
    """struct(ok, crop_x, crop_y, crop_w, crop_h, halvings, resize_w,
    resize_h, out_w, out_h, pad_y) for one transform mode.

    scale: resize to (width, height), a NULL target keeps the source size.
    center-crop: square side min(w, h) centred, resize to the target.
    center-crop-wide: crop height ch = round_half_even(width * h / w) centred,
      resize to (width, height), paste at row (width - height) div 2 of a
      width x width canvas; not ok when w < width or ch < height (P3).
    center-crop-dhariwal: halve (floor) while min >= 2S, scale by S / min with
      half-even rounding, centre-crop S x S (needs width == height)."""
    W, H = col(w).cast("long"), col(h).cast("long")
    tw, th = _lit_or_col(width), _lit_or_col(height)
    zero = F.lit(0).cast("long")
    null = F.lit(None).cast("long")

    def plan(ok, cx, cy, cw, ch, n, rw, rh, ow, oh, pad):
        return F.struct(ok.alias("ok"), cx.alias("crop_x"), cy.alias("crop_y"), cw.alias("crop_w"),
                        ch.alias("crop_h"), n.cast("int").alias("halvings"), rw.alias("resize_w"),
                        rh.alias("resize_h"), ow.alias("out_w"), oh.alias("out_h"), pad.alias("pad_y"))

    if mode == "scale":
        ow, oh = F.coalesce(tw, W), F.coalesce(th, H)
        return plan(F.lit(True), zero, zero, W, H, F.lit(0), ow, oh, ow, oh, null)
    if width is None or height is None:
        raise ValueError("must specify output resolution when cropping")
    if mode == "center-crop":
        side = F.least(W, H)
        return plan(F.lit(True), F.floor((W - side) / 2).cast("long"), F.floor((H - side) / 2).cast("long"),
                    side, side, F.lit(0), tw, th, tw, th, null)
    if mode == "center-crop-wide":
        ch = F.rint(tw.cast("double") * H.cast("double") / W.cast("double")).cast("long")
        ok = ~((W < tw) | (ch < th))
        y0 = F.floor((H - ch) / 2).cast("long")
        return plan(ok, zero, y0, W, ch, F.lit(0), tw, th, tw, tw, F.floor((tw - th) / 2).cast("long"))
    if mode == "center-crop-dhariwal":
        if not isinstance(width, int) or width != height:
            raise ValueError("width and height must match for center-crop-dhariwal")
        s = F.lit(width).cast("long")
        q = F.floor(F.least(W, H) / s).cast("long")
        n = F.when(q >= 1, F.length(F.bin(q)) - 1).otherwise(F.lit(0)).cast("int")
        p2 = F.pow(F.lit(2.0), n).cast("long")
        hw, hh = F.floor(W / p2).cast("long"), F.floor(H / p2).cast("long")
        m = F.least(hw, hh).cast("double")
        scale = s.cast("double") / m
        rw = F.rint(hw.cast("double") * scale).cast("long")
        rh = F.rint(hh.cast("double") * scale).cast("long")
        return plan(F.lit(True), F.floor((rw - s) / 2).cast("long"), F.floor((rh - s) / 2).cast("long"), s, s,
                    n, rw, rh, s, s, null)
    raise ValueError(f"no transform is called {mode!r}")


def size_ok(plan) -> Column:
    """The plan's ``ok`` flag (only center-crop-wide can reject)."""
    return col(plan)["ok"]


def drop_failed(df: DataFrame, ok: str = "ok", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows whose transform failed vanish from the output, surviving rows
    keep their source index (gaps allowed); failures go to a side table."""
    return df.filter(F.col(ok)).drop(error), df.filter(~F.col(ok))


def uniformity(df: DataFrame, w: str = "out_w", h: str = "out_h") -> DataFrame:
    """P5 as one aggregate row: number of distinct sizes, square and
    power-of-two flags (taken from the single size when it is unique)."""
    return df.agg(
        F.count_distinct(F.struct(F.col(w), F.col(h))).alias("n_sizes"),
        F.min(w).alias("width"), F.min(h).alias("height"),
        F.coalesce(F.bool_and(F.col(w) == F.col(h)), F.lit(True)).alias("square"),
        F.coalesce(F.bool_and((F.col(w) > 0) & (F.col(w).bitwiseAND(F.col(w) - 1) == 0)), F.lit(True)).alias("pow2"))


def validate_uniform(df: DataFrame, w: str = "out_w", h: str = "out_h") -> None:
    """P5: raise unless every image has the same size, square, power of two."""
    r = uniformity(df, w, h).first()
    if r["n_sizes"] > 1:
        raise ValueError(f"image sizes are not uniform: {r['n_sizes']} of them")
    if not r["square"]:
        raise ValueError(f"images are not square: {r['width']} x {r['height']}")
    if not r["pow2"]:
        raise ValueError(f"image side {r['width']} is no power-of-two")
