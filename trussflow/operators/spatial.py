"""Boxes, rays, clashes and meshes.

Range joins go through a grid: every box is listed under the cells it meets, boxes meet by equality of cells, and a pair is
kept only in the cell that holds the corner where the two boxes begin to overlap, so no pair needs a distinct. Cells that
very many boxes share are split by a salt on one side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussflow.operators.graph import components

AXES = ("x", "y", "z")
BOX = [f"{m}{a}" for a in AXES for m in ("min", "max")]


def _cells(df: DataFrame, size: tuple[float, float, float], grow: float, axes: tuple[str, ...]) -> DataFrame:
    for a, s in zip(axes, size):
        lo, hi = F.floor((F.col(f"min{a}") - grow) / s), F.floor((F.col(f"max{a}") + grow) / s)
        df = df.withColumn(f"_c{a}", F.explode(F.sequence(lo, hi)))
    return df


def box_pairs(a: DataFrame, b: DataFrame, size: tuple[float, float, float], grow: float = 0.0, axes: tuple[str, ...] = AXES) -> DataFrame:
    """a_id, b_id and both boxes (a_minx, b_minx, ...) whose boxes meet when a's is grown by ``grow``.

    ``size``: edge lengths of a cell; about the size of a typical box is best. Null bounds meet nothing.
    """
    bounds = [f"{m}{x}" for x in axes for m in ("min", "max")]
    a = a.select("id", *bounds).dropna()
    b = b.select("id", *bounds).dropna()
    cells = [f"_c{x}" for x in axes]
    left = _cells(a, size, grow, axes).select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in bounds], *cells)
    right = _cells(b, size, 0.0, axes).select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in bounds], *cells)
    j = left.join(right, cells)  # AQE splits crowded cells
    for x, s in zip(axes, size):
        meets = (F.col(f"a_min{x}") - grow <= F.col(f"b_max{x}")) & (F.col(f"b_min{x}") <= F.col(f"a_max{x}") + grow)
        corner = F.floor(F.greatest(F.col(f"a_min{x}") - grow, F.col(f"b_min{x}")) / s) == F.col(f"_c{x}")
        j = j.where(meets & corner)
    return j.drop(*cells)


def select_box(df: DataFrame, box: dict[str, float], extend: float = 0.0, inside: bool = False) -> DataFrame:
    """Elements whose box meets (or lies within) a box; plain comparisons that reach the scan."""
    for a in AXES:
        lo, hi = box[f"min{a}"] - extend, box[f"max{a}"] + extend
        df = df.where((F.col(f"min{a}") >= lo) & (F.col(f"max{a}") <= hi) if inside else (F.col(f"min{a}") <= hi) & (F.col(f"max{a}") >= lo))
    return df


def select_ray(df: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], length: float = 1000.0) -> DataFrame:
    """Boxes a ray meets within its length, with the distance of entry (slab test)."""
    df = df.dropna(subset=BOX)
    n = sum(d * d for d in direction) ** 0.5
    near, far, ok = F.lit(0.0), F.lit(float(length)), F.lit(True)
    for a, o, d in zip(AXES, origin, direction):
        d /= n
        if d == 0:
            ok = ok & (F.col(f"min{a}") <= o) & (F.col(f"max{a}") >= o)
            continue
        t1, t2 = (F.col(f"min{a}") - o) / d, (F.col(f"max{a}") - o) / d
        near, far = F.greatest(near, F.least(t1, t2)), F.least(far, F.greatest(t1, t2))
    return df.where(ok & (near <= far)).withColumn("distance", near)


def _overlap(x: str) -> Column:
    return F.least(F.col(f"a_max{x}"), F.col(f"b_max{x}")) - F.greatest(F.col(f"a_min{x}"), F.col(f"b_min{x}"))


def clash(a: DataFrame, b: DataFrame, mode: str, size: tuple[float, float, float], tolerance: float = 0.002, clearance: float = 0.05, allow_touching: bool = False, same: bool = False) -> DataFrame:
    """a_id, b_id, type, distance of clashing boxes. ``same``: one set against itself, each unordered pair once.

    intersection: boxes overlap by more than the tolerance in every axis (distance: the least overlap, negative);
    collision: boxes overlap, or touch unless touching is allowed; clearance: boxes are nearer than the clearance.
    """
    pairs = box_pairs(a, b, size, clearance if mode == "clearance" else 0.0)
    if same:
        pairs = pairs.where("a_id < b_id")
    depth = F.least(*[_overlap(x) for x in AXES])
    gap = F.sqrt(sum((F.pow(F.greatest(-_overlap(x), F.lit(0.0)), 2) for x in AXES), F.lit(0.0)))
    if mode == "intersection":
        kept, kind, distance = pairs.where(depth > tolerance), "protrusion", -depth
    elif mode == "collision":
        kept, kind, distance = pairs.where(depth > 0 if allow_touching else depth >= 0), "collision", -depth
    else:
        kept, kind, distance = pairs.where(gap < clearance), "clearance", gap
    return kept.select("a_id", "b_id", F.lit(kind).alias("type"), distance.alias("distance"))


def clusters(points: DataFrame, eps: float) -> DataFrame:
    """id, cluster (least id) of points(id, x, y, z) chained by steps of at most ``eps``; a lone point is its own cluster.

    Points meet through a grid of ``eps``; chains come from connected components.
    """
    boxes = points.select("id", *[F.col(a).alias(f"{m}{a}") for a in AXES for m in ("min", "max")])
    near = box_pairs(boxes, boxes, (eps, eps, eps), eps).where("a_id < b_id")
    d2 = sum((F.pow(F.col(f"a_min{x}") - F.col(f"b_min{x}"), 2) for x in AXES), F.lit(0.0))
    found = components(near.where(d2 <= eps * eps).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return points.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def mesh_quantities(df: DataFrame, key: str = "id") -> DataFrame:
    """key, volume, area, and bounds of triangle meshes (``verts``: flat xyz, ``faces``: flat indexes), by Arrow batches.

    Null or empty meshes have nulls.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for k, verts, faces in zip(pdf[key], pdf["verts"], pdf["faces"]):
                if verts is None or faces is None or not len(verts) or not len(faces):
                    out.append((k, *[None] * 8))
                    continue
                v = np.asarray(verts, float).reshape(-1, 3)
                f = np.asarray(faces, int).reshape(-1, 3)
                p, q, r = v[f[:, 0]], v[f[:, 1]], v[f[:, 2]]
                n = np.cross(q - p, r - p)
                lo, hi = v.min(0), v.max(0)
                out.append((k, abs(float((p * np.cross(q, r)).sum()) / 6), float(np.linalg.norm(n, axis=1).sum() / 2), *map(float, (*lo, *hi))))
            yield pd.DataFrame(out, columns=[key, "volume", "area", "minx", "miny", "minz", "maxx", "maxy", "maxz"])

    kind = dict(df.dtypes)[key]
    return df.select(key, "verts", "faces").mapInPandas(run, f"{key} {kind}, volume double, area double, " + ", ".join(f"{m}{a} double" for m in ("min", "max") for a in AXES))


def mesh_areas(df: DataFrame, key: str = "id", tilt: float = 45.0) -> DataFrame:
    """key, top_area, side_area, footprint_area of triangle meshes.

    Top faces point up within ``tilt`` degrees, side faces lie beyond it from either vertical; the footprint is the area of
    all upward faces seen from above, which is exact for shapes without overhang. Null or empty meshes have nulls.
    """
    limit = float(np.cos(np.radians(tilt)))

    def run(batches):
        for pdf in batches:
            out = []
            for k, verts, faces in zip(pdf[key], pdf["verts"], pdf["faces"]):
                if verts is None or faces is None or not len(verts) or not len(faces):
                    out.append((k, None, None, None))
                    continue
                v = np.asarray(verts, float).reshape(-1, 3)
                f = np.asarray(faces, int).reshape(-1, 3)
                n = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]]) / 2
                area = np.linalg.norm(n, axis=1)
                up = np.divide(n[:, 2], area, out=np.zeros_like(area), where=area > 0)
                out.append((k, float(area[up > limit].sum()), float(area[np.abs(up) <= limit].sum()), float(n[:, 2].clip(0).sum())))
            yield pd.DataFrame(out, columns=[key, "top_area", "side_area", "footprint_area"])

    return df.select(key, "verts", "faces").mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, top_area double, side_area double, footprint_area double")


def shape_summary(df: DataFrame, key: str = "id") -> DataFrame:
    """key, n_verts, n_faces, total, least, most: what a comparison of shapes looks at, by array functions alone."""
    total = F.aggregate("verts", F.lit(0.0), lambda a, x: a + x)
    return df.select(key, (F.size("verts") / 3).cast("int").alias("n_verts"), (F.size("faces") / 3).cast("int").alias("n_faces"), total.alias("total"), F.array_min("verts").alias("least"), F.array_max("verts").alias("most"))


def box_mesh(df: DataFrame, key: str = "id") -> DataFrame:
    """key, verts, faces of boxes, as twelve triangles."""
    corners = [(x, y, z) for z in ("minz", "maxz") for y in ("miny", "maxy") for x in ("minx", "maxx")]
    verts = F.array(*[F.col(c) for corner in corners for c in corner])
    faces = [0, 2, 1, 1, 2, 3, 4, 5, 6, 5, 7, 6, 0, 1, 4, 1, 5, 4, 2, 6, 3, 3, 6, 7, 0, 4, 2, 2, 4, 6, 1, 3, 5, 3, 7, 5]
    return df.select(key, verts.alias("verts"), F.array(*[F.lit(i) for i in faces]).alias("faces"))


def placement(chain: DataFrame, group: str = "id") -> DataFrame:
    """group, matrix: product of 4x4 row-major matrices (``step``, ``m``) from the outermost to the innermost."""
    ms = F.transform(F.array_sort(F.collect_list(F.struct("step", "m"))), lambda x: x["m"])
    eye = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    mul = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, k: s + F.get(a, (F.floor(i / 4) * 4).cast("int") + k) * F.get(b, k * 4 + i % 4)))
    return chain.groupBy(group).agg(F.aggregate(ms, eye, mul).alias("matrix"))
