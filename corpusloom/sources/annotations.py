"""The four tables of an annotation database."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Annotations(NamedTuple):
    projects: DataFrame  # id, name
    label_types: DataFrame  # id, project_id, text
    labels: DataFrame  # example_id, label_id
    examples: DataFrame  # id, meta


#: Table and columns read for each member of ``Annotations``.
TABLES = {
    "projects": ("projects_project", ("id", "name")),
    "label_types": ("label_types_categorytype", ("id", "project_id", "text")),
    "labels": ("labels_category", ("example_id", "label_id")),
    "examples": ("examples_example", ("id", "meta")),
}


def read_annotations(spark: SparkSession, source: str, **jdbc: str) -> Annotations:
    """Read from a folder of parquet extracts, or from a JDBC url.

    For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` to read the large tables in parallel.  They apply to
    ``labels`` and ``examples`` only, as ``labels.partitionColumn`` and so on.
    """
    def table(member: str) -> DataFrame:
        name, columns = TABLES[member]
        if source.startswith("jdbc:"):
            own = {k.split(".", 1)[1]: v for k, v in jdbc.items() if k.startswith(f"{member}.")}
            common = {k: v for k, v in jdbc.items() if "." not in k}
            reader = spark.read.format("jdbc").options(url=source, dbtable=name, **common, **own)
            return reader.load().select(*columns)
        return spark.read.parquet(f"{source}/{name}").select(*columns)

    return Annotations(**{member: table(member) for member in TABLES})
