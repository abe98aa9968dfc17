"""Label tables as generations of whole hosts, published together.

Labels look back and ahead in time, so a host's labels are always made anew as a whole. Every run
writes the hosts it has labelled into folders of their own, ``<table>/Generation=<id>/<host>/…``, and
touches nothing that a reader may be reading. One last small write, the publication, names the
generation of every host and table. It counts once Spark has committed it, so a run that fails
before that changes nothing for readers, whatever it has written, and two tables of one publication
belong together. One run writes at a time; two that end up with one number make the second fail.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyline.schema import HOST, PUBLICATIONS, TABLES
from tallyline.sources.scratch import names_matching, path_exists, remove_path

GENERATION = "Generation"
# Up to so many folders of hosts are listed in the plan of a reader.
LISTED = 1000


def number(warehouse) -> int:
    """The last publication, 0 before the first."""
    rows = warehouse.read(PUBLICATIONS.name)
    return rows.agg(F.max("Publication")).first()[0] or 0


def published(warehouse, publication: int | None = None) -> DataFrame:
    """The rows of a publication, the last one unless told."""
    publication = number(warehouse) if publication is None else publication
    return warehouse.read(PUBLICATIONS.name).where(F.col("Publication") == publication)


def read(warehouse, name: str, publication: int | None = None) -> DataFrame:
    """A table as of a publication. Up to ``LISTED`` folders of hosts are named one by one, and nothing
    else is even listed; of more, the generations are read and the hosts joined."""
    schema = TABLES[name].schema
    wanted = published(warehouse, publication).where((F.col("TableName") == name) & F.col(HOST).isNotNull())
    wanted = wanted.select(GENERATION, HOST)
    listed = wanted.limit(LISTED + 1).collect()
    if not listed:
        return warehouse.spark.createDataFrame([], schema)
    folders = [f"{GENERATION}={r[0]}/{HOST}={r[1]}" for r in listed]
    if len(listed) > LISTED:
        folders = [f"{GENERATION}={r[0]}" for r in wanted.select(GENERATION).distinct().collect()]
    rows = (
        warehouse.spark.read.schema(StructType([*schema, StructField(GENERATION, StringType())]))
        .option("basePath", warehouse.path(name))
        .format(warehouse.fmt)
        .load([f"{warehouse.path(name)}/{folder}" for folder in sorted(folders)])
    )
    if len(listed) > LISTED:
        rows = rows.join(wanted, [GENERATION, HOST], "left_semi")
    return rows.select(*schema.names)


class Generation:
    """The tables of one run, not visible until they are published."""

    def __init__(self, warehouse) -> None:
        self.warehouse = warehouse
        self.before = number(warehouse)
        self.id = f"{self.before + 1:08d}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.warehouse.path(name)}/{GENERATION}={self.id}"

    def write(self, name: str, df: DataFrame, pieces: int = 1) -> DataFrame:
        """Store rows of whole hosts, each in so many pieces at least; returns them as stored."""
        self.warehouse.save(name, df, self.path(name), pieces)
        self.names.append(name)
        return self.rows(name)

    def rows(self, name: str) -> DataFrame:
        schema = TABLES[name].schema
        rows = self.warehouse.spark.read.schema(schema).format(self.warehouse.fmt).load(self.path(name))
        return rows.select(*schema.names)

    def hosts(self, name: str) -> DataFrame:
        return self.rows(name).select(HOST).distinct()

    def publish(self, hosts: DataFrame | None = None, policy: str | None = None, through: int | None = None) -> int:
        """Make the tables visible, in place of all rows of their ``hosts`` (all hosts unless told):
        of these, a host without rows has none from now on. Other hosts and tables stay. A row
        without a host, of every table written, tells of the run even if no host is left."""
        warehouse, names = self.warehouse, self.names
        kept = published(warehouse, self.before).drop("Publication")
        mine = F.col("TableName").isin(names)
        if hosts is None:
            kept = kept.where(~mine)
        else:
            gone = hosts.select(F.col(HOST).alias("gone")).distinct()
            stays = ~mine | F.col("gone").isNull()
            kept = kept.join(gone, kept[HOST] == gone["gone"], "left").where(stays & ~(mine & F.col(HOST).isNull())).drop("gone")
        rows = kept
        for name in names:
            made = self.hosts(name).unionByName(warehouse.spark.createDataFrame([(None,)], f"{HOST} string"))
            made = made.select(
                F.lit(name).alias("TableName"), HOST, F.lit(self.id).alias(GENERATION),
                F.lit(policy).cast("string").alias("Policy"), F.lit(through).cast("long").alias("ThroughLoad"),
            )
            rows = rows.unionByName(made)
        (
            rows.coalesce(1)
            .write.mode("error")
            .format(warehouse.fmt)
            .save(f"{warehouse.path(PUBLICATIONS.name)}/Publication={self.before + 1}")
        )
        return self.before + 1


def last_run(warehouse, name: str) -> tuple[str | None, int | None]:
    """Policy and last load that the published rows of a table stand for."""
    row = published(warehouse).where((F.col("TableName") == name) & F.col(HOST).isNull()).first()
    return (row.Policy, row.ThroughLoad) if row else (None, None)


def clean_up(warehouse, keep: int = 2) -> None:
    """Remove the generations that none of the last ``keep`` publications names, and the publications
    before these. For times at which nothing is being written."""
    last = number(warehouse)
    rows = warehouse.read(PUBLICATIONS.name)
    recent = rows.where(F.col("Publication") > last - keep)
    in_use = {(r[0], r[1]) for r in recent.select("TableName", GENERATION).distinct().collect()}
    for name, table in TABLES.items():
        if table.published and path_exists(warehouse.spark, warehouse.path(name)):
            for folder in names_matching(warehouse.spark, f"{warehouse.path(name)}/{GENERATION}=*"):
                generation = folder.split("=", 1)[1]
                if (name, generation) not in in_use:
                    remove_path(warehouse.spark, f"{warehouse.path(name)}/{GENERATION}={generation}")
    warehouse.drop(PUBLICATIONS.name, rows.where(F.col("Publication") <= last - keep).select("Publication"))
