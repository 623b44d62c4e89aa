"""Matrices, rotations and meshes as column expressions. Matrices are arrays of 16 numbers, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import gather, matrix_product, quaternion_inverse

Number = Column | float


def matrix(rows: list[list[Number]]) -> Column:
    return F.array(*((c if isinstance(c, Column) else F.lit(float(c))).cast("double") for r in rows for c in r))


def identity() -> Column:
    return matrix([[float(r == c) for c in range(4)] for r in range(4)])


def translation(x: Number, y: Number, z: Number) -> Column:
    return matrix([[1, 0, 0, x], [0, 1, 0, y], [0, 0, 1, z], [0, 0, 0, 1]])


def rotation(q: Column) -> Column:
    """Of a quaternion x, y, z, w: by the products of its parts."""
    v = {c: q[c].cast("double") for c in "xyzw"}
    two = lambda a, b: v[a] * v[b] * 2
    diagonal = lambda a, b: F.lit(1.0) - two(a, a) - two(b, b)
    return matrix(
        [
            [diagonal("y", "z"), two("x", "y") - two("w", "z"), two("x", "z") + two("w", "y"), 0],
            [two("x", "y") + two("w", "z"), diagonal("x", "z"), two("y", "z") - two("w", "x"), 0],
            [two("x", "z") - two("w", "y"), two("y", "z") + two("w", "x"), diagonal("x", "y"), 0],
            [0, 0, 0, 1],
        ]
    )


def axis_rotation(axis: str, angle: Column) -> Column:
    """By an angle in the plane of the two other axes; about y, the sine's signs are those of the other two."""
    a, b = {"x": (1, 2), "y": (0, 2), "z": (0, 1)}[axis]
    rows: list[list[Number]] = [[float(r == c) for c in range(4)] for r in range(4)]
    rows[a][a] = rows[b][b] = F.cos(angle)
    rows[a][b], rows[b][a] = -F.sin(angle), F.sin(angle)
    return matrix(rows)


def projection(near: Number, ratio: Column) -> Column:
    """With infinite far distance; width and height are scaled by the root of their ratio."""
    side = F.sqrt(ratio)
    return matrix([[side, 0, 0, 0], [0, F.lit(1.0) / side, 0, 0], [0, 0, 0, near], [0, 0, 1, 0]])


def swapped_axes(m: Column, a: int, b: int) -> Column:
    order = list(range(4))
    order[a], order[b] = b, a
    return F.array(*(F.element_at(m, r * 4 + c + 1) for r in order for c in range(4)))


def moved(m: Column, x: Column, y: Column, z: Column) -> Column:
    """A point under a matrix, as a struct."""
    at = lambda r: F.element_at(m, r * 4 + 1) * x + F.element_at(m, r * 4 + 2) * y + F.element_at(m, r * 4 + 3) * z + F.element_at(m, r * 4 + 4)
    return F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def view_matrix(x: Column, y: Column, pan: tuple[Number, Number, Number], distance: Number) -> Column:
    """Seen from a distance, turned about two axes and moved; the last two axes change places first."""
    turned = matrix_product(matrix_product(translation(0, 0, distance), axis_rotation("x", x)), axis_rotation("y", y))
    return matrix_product(turned, matrix_product(translation(*pan), swapped_axes(identity(), 1, 2)))


def inverse_transform(t: Column, q: Column) -> Column:
    """The inverse of a turn by q and a move by t (x, y, z), as the turn back and the move that undoes it."""
    back = quaternion_inverse(q)
    return F.struct(moved(rotation(back), -t["x"], -t["y"], -t["z"]).alias("translation"), back.alias("rotation"))


#: Attributes of a vertex that say how it is blended and morphed.
BLENDING = ("BlendValues1", "BlendValues2", "BoneValues", "DeformMask", "VertexID", "RegionMask")


def drawn_attributes(attributes: Column) -> Column:
    """A mesh's attributes (binding, ...) that are drawn as they are."""
    return F.filter(attributes, lambda a: ~a["binding"].isin(list(BLENDING)))


def morph_names(morphs: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """by and `names`: for each target in order the name of its morph (by, morph, name), empty where it has none."""
    named = morphs.join(names, [*by, "morph"], "left")
    pairs = F.array_sort(F.collect_list(F.struct("target", F.coalesce("name", F.lit("")).alias("name"))))
    return named.groupBy(*by).agg(F.transform(pairs, lambda p: p["name"]).alias("names"))


def running_offsets(rows: DataFrame, by: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """rows with where each part begins behind the parts before it."""
    at = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(size).over(at) - F.col(size))


def bone_keys(keys: Column, bones: Column) -> Column:
    """Keys of a mesh as bones of the skeleton; 255 marks none, which is bone 0."""
    return F.transform(keys, lambda k: F.when(k == 255, 0).otherwise(F.get(bones, k)))


def attribute_data(groups: Column, group: Column, buffers: Column) -> Column:
    """The buffers that a mesh's attribute group refers to."""
    return gather(buffers, F.element_at(groups, group + 1))


def morph_ids(keys: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, morph, target: each distinct key once, numbered from 0 in order."""
    ids = keys.groupBy(*by).agg(F.array_sort(F.collect_set(column)).alias("_ids"))
    return ids.select(*by, F.posexplode("_ids").alias("target", "morph")).select(*by, "morph", "target")


def scattered(deltas: Column, keys: Column, morph: Column, zero: Column) -> Column:
    """A morph's deltas by vertex: where the vertex's key is the morph's, else what was there before."""
    at = F.arrays_zip(deltas.alias("d"), keys.alias("k"), zero.alias("z"))
    return F.transform(at, lambda e: F.when(e["k"] == morph, e["d"]).otherwise(e["z"]))


def slot_keys(deltas: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """deltas (slot) with the last blend keys (slot, position, keys) whose slot is a quarter of theirs; others go."""
    last = keys.groupBy(*by, "slot").agg(F.max_by("keys", "position").alias("keys")).withColumnRenamed("slot", "_of")
    return deltas.withColumn("_of", F.expr("slot div 4")).join(last, [*by, "_of"]).drop("_of")
