"""Seed reference data of the schema (dam types, data sources, regions).

These rows are constants of the schema, used as the small side of joins with
the data tables; they are never analysed on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Seed rows of the schema (type ids are assigned 1..8 in order).
# ---------------------------------------------------------------------------
DAM_TYPES = [
    (1, "Arch Dam", "structural", "Curved concrete/masonry dam transferring load to abutments",
     ["hydropower", "water_supply"]),
    (2, "Gravity Dam", "structural", "Straight dam resisting water pressure through weight",
     ["hydropower", "flood_control"]),
    (3, "Embankment Dam", "structural", "Earth/rock fill dam", ["flood_control", "water_supply", "hydropower"]),
    (4, "Buttress Dam", "structural", "Reinforced concrete with supporting buttresses",
     ["hydropower", "water_supply"]),
    (5, "Hydropower Dam", "functional", "Dam with electricity generation facilities", ["hydropower"]),
    (6, "Flood Control Dam", "functional", "Dam primarily for flood mitigation", ["flood_control"]),
    (7, "Water Supply Dam", "functional", "Dam for municipal/industrial water supply", ["water_supply"]),
    (8, "Multi-Purpose Dam", "functional", "Dam serving multiple functions",
     ["hydropower", "flood_control", "water_supply"]),
]

DAM_TYPES_SCHEMA = T.StructType([
    T.StructField("type_id", T.IntegerType(), False),
    T.StructField("type_name", T.StringType(), False),
    T.StructField("type_category", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("typical_applications", T.ArrayType(T.StringType()), True),
])


def dam_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DAM_TYPES, DAM_TYPES_SCHEMA)
