"""From tracks to rows ready for assembly: filter, condense, mirror, measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import augment, filters, pose


def _categories(names: list[str], y: str) -> dict[str, Column]:
    """The column of each category that predicates name; one that a row's map lacks is NULL and matches nothing."""
    plain = {n.split("==")[0].strip() for n in names} - {"male"} | {"female"}
    return {n: F.try_element_at(F.col(y), F.lit(n)) for n in plain}


def training_rows(tracks: DataFrame, categories: list[str] = (), output_categories: list[str] = (), mirror: bool = False, video: str = "videoidx", id: str = "id", agent: str = "agent", kp: str = "kp", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): tracks and each individual's sizes, all lazily planned. ``track`` names an agent slot of a video: slots and frame
    numbers of different archives and of mirrored copies are alike.

    isdata and useoutputmask are narrowed by category predicates on the map ``y``; videos and agent slots without any valid row go;
    mirrored copies get ids and video numbers of their own; sizes are medians over an individual's valid rows, and individuals with a
    size missing are no data. ``tracks`` has isdata and useoutputmask, as archives give them.
    """
    rows = tracks
    if categories:
        rows = filters.with_category_mask(rows, "isdata", list(categories), _categories(list(categories), y))
    if output_categories:
        rows = filters.with_category_mask(rows, "useoutputmask", list(output_categories), _categories(list(output_categories), y))
    rows = filters.condense(rows, video, F.col("isdata"))
    # a slot that never has a point is none
    seen = rows.where(F.exists(kp, lambda p: p["x"].isNotNull())).select(video, agent).distinct()
    rows = rows.join(seen, [video, agent], "left_semi")
    if mirror:
        rows = augment.with_mirrored(rows, [video, id], kp).drop("mirrored")
    sizes = pose.scales(rows.where("isdata"), id, kp)
    rows = filters.drop_incomplete(rows, sizes, id, list(pose.SCALES))
    known = sizes.where(" and ".join(f"{c} is not null" for c in pose.SCALES))
    # an individual without any valid row has no sizes at all
    rows = rows.join(known.select(id), id, "left_semi")
    return rows.withColumn("track", F.concat_ws("/", video, agent)), known
