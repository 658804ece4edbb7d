"""Scalar rules of the scene data model as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class vocabularies.
GROUND_CLASSES = ("floor", "ground", "terrain")
RIGID_STRUCTURE_CLASSES = ("wall", "floor", "ground", "terrain", "rail", "track", "road", "block", "slab", "beam", "lawn", "grass", "carpet", "mat")
STATIC_CLASSES = (
    "wall", "floor", "ground", "table", "track", "rail", "block", "slab", "beam", "belt", "conveyor", "road", "shelf", "counter", "desk", "lawn", "grass", "carpet", "mat", "base",
)
#: Class patterns that choose a primitive, in order.
FALLBACK_SHAPES = (
    ("coin|disc|ring|wheel", "cylinder"), ("ball|sphere|orb|marble", "sphere"), ("tree|plant|bush", "composite"),
    ("train|car|cart|vehicle|truck|bus|locomotive", "composite"), ("door|gate|panel", "box"),
)


def r6(c: Column) -> Column:
    """Six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def node_extent(shape: Column, radius: Column, height: Column, extent: Column) -> Column:
    """Edge lengths [x, y, z] of a node's geometry; null unless all are positive.

    A sphere is 2r wide; a cylinder or cone is 2r by its height, which defaults to 2r; else the extent counts.
    """
    d = 2 * radius
    h = F.coalesce(height, d)
    whole = (F.size(extent) == 3) & F.forall(extent, lambda e: e > 0)
    return (
        F.when(shape == "sphere", F.when(d > 0, F.array(d, d, d)))
        .when(shape.isin("cylinder", "cone"), F.when((d > 0) & (h > 0), F.array(d, h, d)))
        .when(whole, extent)
    )


def effective_shape(kind: Column, shape: Column, ref: Column, name: Column) -> Column:
    """What a node is drawn as: its primitive, a mesh if its asset resolved, else the first class pattern that fits."""
    lowered = F.lower(F.coalesce(name, F.lit("")))
    fallback = F.lit("box")
    for pattern, out in reversed(FALLBACK_SHAPES):
        fallback = F.when(lowered.rlike(pattern), out).otherwise(fallback)
    has_ref = ref.isNotNull() & (ref != "")
    return (
        F.when(kind == "primitive", F.coalesce(shape, F.lit("box"))).when(kind == "composite", F.lit("composite"))
        .when(kind.isin("asset", "generated"), F.when(has_ref, F.lit("mesh")).otherwise(fallback))
    )


def edge_ratios(extent: Column) -> Column:
    """Edges in falling order, divided by the longest."""
    return F.transform(F.reverse(F.array_sort(extent)), lambda e: e / F.array_max(extent))


def shape_error(a: Column, b: Column) -> Column:
    """Mean absolute difference of two lists of edge ratios."""
    return F.aggregate(F.zip_with(edge_ratios(a), edge_ratios(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 3


def scale_ratio(truth: Column, predicted: Column) -> Column:
    return F.array_max(predicted) / F.array_max(truth)


def longest_edge(extent: Column, size: Column, radius: Column, height: Column) -> Column:
    """Longest of extent or size, else of diameter and height; null unless over a millionth."""
    longest = F.coalesce(F.array_max(extent), F.array_max(size), F.greatest(2 * radius, height))
    return F.when(longest > 1e-6, longest)


def longest_of_boxes(boxes: Column) -> Column:
    """Longest edge over all boxes (arrays of edges) that an object was seen with; null unless over a millionth."""
    longest = F.array_max(F.transform(boxes, lambda b: F.array_max(b)))
    return F.when(longest > 1e-6, longest)


def norm_class(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def is_ground(name: Column) -> Column:
    """The whole class name is a ground class; a floor lamp is not."""
    return norm_class(name).isin(*GROUND_CLASSES)


def is_rigid_structure(name: Column) -> Column:
    return norm_class(name).isin(*RIGID_STRUCTURE_CLASSES)


def is_static(name: Column, classes: tuple[str, ...] = STATIC_CLASSES) -> Column:
    """One of the name's words is a static class; a tablet is no table."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(c) for c in classes]))


def slug(text: Column, most: int = 40) -> Column:
    """A program id: letters, digits and underscores, a letter first."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(s.rlike("^[A-Za-z]"), s).otherwise(F.concat(F.lit("o_"), s)), 1, most)


def quat_multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of quaternions in x, y, z, w order."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def quat_angle_deg(a: list[Column], b: list[Column]) -> Column:
    """Angle between two unit quaternions; q and -q are one rotation."""
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    return F.degrees(2 * F.acos(F.least(F.abs(dot), F.lit(1.0))))


def upper_median(sorted_values: Column) -> Column:
    """Element n div 2 of a sorted array."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def lower_median(sorted_values: Column) -> Column:
    return F.get(sorted_values, F.floor((F.size(sorted_values) - 1) / 2).cast("int"))
