"""A store of labelled patterns as a Parquet table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import escaped, rule_line, vector_text
from ..session import materialise

SCHEMA = (
    T.StructType()
    .add("id", T.LongType())
    .add("label", T.StringType())
    .add("embedding", T.ArrayType(T.FloatType()))
    .add("features", T.ArrayType(T.DoubleType()))
    .add("energies", T.ArrayType(T.DoubleType()))
)


def insert_if_absent(batch: DataFrame, stored: DataFrame, label_col: str = "label", order_col: str = "position") -> DataFrame:
    """``batch`` with added boolean: the first row (by ``order_col``, which tells rows apart) of each label that ``stored`` lacks.

    Others are ignored labels. A null label is never added. Labels fold to their first places before any join.
    """
    known = stored.select(F.col(label_col).alias("_label")).distinct()
    fresh = batch.groupBy(F.col(label_col).alias("_label")).agg(F.min(order_col).alias("_first")).join(known, "_label", "left_anti")
    marked = batch.join(fresh, F.col(label_col) == F.col("_label"), "left")
    return marked.withColumn("added", F.coalesce(F.col(order_col) == F.col("_first"), F.lit(False))).drop("_label", "_first")


def numbered(rows: DataFrame, order: list[str], first: int = 1, name: str = "id") -> DataFrame:
    """``rows`` with whole numbers from ``first`` in their order: sorted by ranges, each partition counts on from those before it."""
    placed = materialise(rows.drop(name).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.lit(first) + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


class Conflict(RuntimeError):
    """Other writers kept coming first."""


class RuleStore:
    """Rules under a path that executors reach. Each write is a folder of its own, in order; readers see whole ones, since the last that cleared the store.

    A write is prepared beside the store, from what it holds then, and takes the next number by creating a file that
    nobody else may have created. Who comes second prepares it again from what the first has written.
    Columns can be added; the schema is a version like any write, and rows written before it have nulls there.
    """

    #: Seconds that a taken number may stay without its folder before it counts as given up, and attempts of a write.
    patience, attempts = 30.0, 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at, lambda name: jvm.org.apache.hadoop.fs.Path(at, name)

    def _names(self) -> list[str]:
        fs, at, _ = self._files()
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _written(self) -> list[str]:
        """Names of the complete folders, in order."""
        fs, _, path = self._files()
        return [n for n in self._names() if n.startswith("v") and not n.endswith(".taken") and fs.exists(path(f"{n}/_SUCCESS"))]

    def schema(self, names: list[str] | None = None) -> T.StructType:
        """That of the newest version of columns."""
        names = [n for n in (self._written() if names is None else names) if "-columns-" in n]
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/{names[-1]}").first()[0])) if names else SCHEMA

    def _rules(self, names: list[str]) -> DataFrame:
        since = max((k for k, n in enumerate(names) if "-clear-" in n), default=-1) + 1
        paths, schema = [f"{self.path}/{n}" for n in names[since:] if "-add-" in n], self.schema(names)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rules(self) -> DataFrame:
        return self._rules(self._written())

    def _commit(self, kind: str, write: Callable[[list[str], str], object]) -> object:
        """Lets ``write(names so far, folder)`` prepare a folder until it can take the number after those names; returns what it returned."""
        fs, _, path = self._files()
        for _ in range(self.attempts):
            names = self._written()
            taken = [int(n[1:9]) for n in self._names() if n.startswith("v")]
            n = max(taken, default=-1) + 1
            if n - 1 in taken and not any(x.startswith(f"v{n - 1:08d}-") for x in names) and not self._settled(n - 1):
                names = self._written()
            folder = f"_new-{uuid.uuid4().hex}"
            out = write(names, f"{self.path}/{folder}")
            # A number that was given up is passed over; one that was taken since then is a conflict.
            if self._written() == names and fs.createNewFile(path(f"v{n:08d}.taken")):
                fs.rename(path(folder), path(f"v{n:08d}-{kind}-{uuid.uuid4().hex[:8]}"))
                return out
            fs.delete(path(folder), True)
        raise Conflict(f"{self.attempts} attempts to write to {self.path} came second")

    def _settled(self, n: int) -> bool:
        """Waits for the folder of a number that somebody has taken; whether it has been given up."""
        until = time.monotonic() + self.patience
        while time.monotonic() < until:
            if any(x.startswith(f"v{n:08d}-") for x in self._written()):
                return False
            time.sleep(0.1)
        return True

    def _rows(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def set_columns(self, schema: str | T.StructType) -> None:
        """The columns of a new store; it must have id, label and embedding, and hold no rows."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not {"id", "label", "embedding"} <= set(schema.names):
            raise ValueError("a store has id, label and embedding")
        if not self.rules().isEmpty():
            raise ValueError("the store holds rows; columns can only be added")
        self._set(schema)

    def _set(self, schema: T.StructType) -> None:
        self._commit("columns", lambda _, folder: self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(folder))

    def add_columns(self, columns: str) -> None:
        """Adds columns (DDL) that the store lacks; rows written before have nulls there. One that is there with another type is an error."""
        schema = self.schema()
        own = {f.name.lower(): f for f in schema}
        new = []
        for f in T.StructType.fromDDL(columns):
            if f.name.lower() not in own:
                new.append(f)
            elif own[f.name.lower()].dataType != f.dataType:
                raise ValueError(f"{f.name} is there as {own[f.name.lower()].dataType.simpleString()}")
        if new:
            self._set(T.StructType([*schema.fields, *new]))

    def add(self, batch: DataFrame, unless_present: bool = True, order_col: str = "position") -> DataFrame:
        """Adds (label, embedding, and other columns of the store) rows, numbered on from the largest id in their order; returns (label, added).

        Only the new rows are written. Columns that the store lacks are ignored.
        """

        def write(names: list[str], folder: str) -> DataFrame:
            stored, schema = self._rules(names), self.schema(names)
            known = [c for c in batch.columns if c in schema.names or c == order_col]
            marked = insert_if_absent(batch.select(*known), stored, order_col=order_col) if unless_present else batch.select(*known).withColumn("added", F.lit(True))
            marked = materialise(marked, "rules")
            top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            self._rows(numbered(marked.filter("added"), [order_col], top + 1), schema).write.parquet(folder)
            return marked.select("label", "added")

        return self._commit("add", write)

    def clear(self) -> None:
        """Empties the store; its columns stay."""
        self._commit("clear", lambda names, folder: self.spark.createDataFrame([], self.schema(names)).write.parquet(folder))

    def get(self, id_: int) -> DataFrame:
        return self.rules().filter(F.col("id") == id_)

    def listing(self, preview: int = 16) -> DataFrame:
        """(id, label, dim, preview) by id."""
        return self.rules().select("id", "label", F.size("embedding").alias("dim"), F.slice("embedding", 1, preview).alias("preview")).orderBy("id")

    def dump(self, most: int = 8, html: bool = False) -> DataFrame:
        """(id, line): one text line, or one table row of HTML, for each rule by id."""
        cells = F.concat(F.lit("<tr><td>"), F.col("id").cast("string"), F.lit("</td><td>"), escaped(F.col("label")), F.lit("</td><td><code>"), vector_text("embedding", most), F.lit("</code></td></tr>"))
        return self.rules().select("id", (cells if html else rule_line("id", "label", "embedding", most)).alias("line")).orderBy("id")
