"""Rectangles anywhere in JSON documents: each text is read once and searched where it lies, as deep as it goes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.functions.boxes import BOX, first_box


def _boxes(texts: pa.Array) -> pa.Array:
    found = [first_box(t) for t in texts.to_pylist()]
    none = pa.array([b is None for b in found], pa.bool_())
    return pa.StructArray.from_arrays([pa.array([b and b[k] for b in found], pa.int32()) for k in range(4)], names=list("xywh"), mask=none)


def find_boxes(rows: DataFrame, json: Column, keys: list[str]) -> DataFrame:
    """keys and box (x, y, w, h; null where there is none) of each row's JSON text in any of the usual encodings.

    Lists of four are x, y, width and height first, and corners if that is no valid box. An object with the keys of an encoding is
    judged by these alone, others by their polygons, then by the usual nested names, then by all their values as they are
    written, each of which is searched whole before the next. Boxes are at least one unit wide and high. Null, empty and malformed texts have none.

    Rows stay where they are: nothing is shuffled or written, whatever the depth of the documents.
    """
    return rows.select(*keys, F.arrow_udf(_boxes, BOX)(json).alias("box"))
