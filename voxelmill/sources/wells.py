"""Folders of well plates: a file a plane, whose name says its well, loop, channel and slice (`-A001--PO01--LO001--CO6--SL010--PX16250--...`).

A folder is a dataset, a well a series; wells go by their row's letters (AA after P), then by their number. Values of a field are ranked within the dataset, so axes count from 0 whatever numbers were recorded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields of names as axes, and the unit of the pixel size in micrometres.
FIELDS = {"t": "LO", "c": "CO", "z": "SL"}
WELL, SIZE, UNIT = "-((?:[A-P]|A[A-F])[0-9]+)--", "--PX([0-9]+)", 1e-4


def well_plan(plan: DataFrame, by_position: bool = False) -> DataFrame:
    """A plan of `arrays.plane_plan` with dataset, well, position (null without one), series, scale (micrometres a pixel, else 1), and t, c and z from the names.

    Only files whose names tell a well are kept. With `by_position` positions of a well are series of their own. A field that names lack is 0.
    """
    name = F.substring_index("path", "/", -1)
    number = lambda field: F.nullif(F.regexp_extract(name, f"--{field}([0-9]+)", 1), F.lit("")).cast("long")
    size = F.nullif(F.regexp_extract(name, SIZE, 1), F.lit("")).cast("double") * UNIT
    named = plan.withColumns({
        "dataset": F.regexp_replace("path", "/[^/]*$", ""), "well": F.regexp_extract(F.concat(F.lit("-"), name), WELL, 1), "position": number("PO"), "scale": F.coalesce(size, F.lit(1.0)),
        **{f"__{a}": F.coalesce(number(f), F.lit(0)) for a, f in FIELDS.items()},
    }).where("well <> ''")
    ranks = {"series": ["well", "position"] if by_position else ["well"], **{a: [f"__{a}"] for a in FIELDS}}
    letters = F.regexp_extract("well", "^[A-Z]+", 0)
    natural = [F.length(letters), letters, F.regexp_extract("well", "[0-9]+$", 0).cast("decimal(38,0)")]
    out = named.drop(*FIELDS)
    for axis, fields in ranks.items():
        # A plate's distinct values of one field: at most its wells, loops, channels or slices.
        values = named.select("dataset", *fields).distinct()
        ranked = values.withColumn(axis, (F.row_number().over(Window.partitionBy("dataset").orderBy(*(natural if fields[0] == "well" else []), *fields)) - 1).cast("int"))
        same = [F.col("o.dataset") == F.col("r.dataset"), *[F.col(f"o.{f}").eqNullSafe(F.col(f"r.{f}")) for f in fields]]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        out = out.alias("o").join(ranked.alias("r"), condition).select("o.*", f"r.{axis}")
    return out.select(*plan.columns, "dataset", "well", "position", "series", "scale")
