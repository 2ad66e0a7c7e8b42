"""The engine's tables: each defined once over others, built when first needed and kept as Parquet for the session.

A table has a Spark definition (SQL over other tables, or a function of the store) and an equivalent DuckDB definition, from which the
oracle of any query over the tables is put together.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

SOURCES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
_WORD = re.compile(r"\b[a-z_][a-z_0-9]*\b")

SPARK: dict[str, str | Callable[["Store"], DataFrame]] = {}
DUCK: dict[str, str] = {}
#: Tables that are cheap over others stay views; a function of the store tells whether a table is kept.
VIEWS: set[str] = set()
KEEPS: dict[str, Callable[["Store"], bool]] = {}


def table(name: str, sql: str | None = None, duck: str | None = None, view: bool | Callable[["Store"], bool] = False):
    """Define a table by SQL for both engines, or as a decorator by a Spark function and DuckDB SQL."""

    def add(definition):
        SPARK[name], DUCK[name] = definition, duck or sql
        if callable(view):
            KEEPS[name] = view
        elif view:
            VIEWS.add(name)
        return definition

    return add(sql) if sql else add


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.getCheckpointDir() is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessitura-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect its garbage: for frames that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_STORES: dict[tuple[str, str], "Store"] = {}


def opened(spark: SparkSession, sf_dir: str) -> "Store":
    """The session's store of a data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = Store(spark, sf_dir)
    return _STORES[key]


class Store:
    """Tables of one corpus. ``songs`` replaces the corpus derived from ``documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, songs: DataFrame | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}"
        self.kept: dict[str, DataFrame] = {}
        if songs is not None:
            self.keep("songs", songs)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").parquet(path)
        self.kept[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.kept[name]

    def table(self, name: str) -> DataFrame:
        if name not in self.kept:
            if name in SOURCES:
                self.kept[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                definition = SPARK[name]
                df = self.sql(definition) if isinstance(definition, str) else definition(self)
                if name in VIEWS or name in KEEPS and not KEEPS[name](self):
                    self.kept[name] = df
                else:
                    self.keep(name, df)
        return self.kept[name]

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Spark SQL over the store's tables; ``args`` are the values of named parameters."""
        for name in names_in(text):
            self.table(name)
        for name in names_in(text):
            self.kept[name].createOrReplaceTempView(name)
        return self.spark.sql(text, args)


def names_in(sql: str) -> list[str]:
    return [x for x in dict.fromkeys(_WORD.findall(re.sub(r"'[^']*'", "", sql))) if x in SPARK or x in SOURCES]


def oracle(sql: str) -> str:
    """DuckDB SQL of a query over the store's tables: the definitions it needs as common table expressions before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in names_in(text):
            if name in DUCK and name not in order:
                need(DUCK[name])
                if name not in order:
                    order.append(name)

    need(sql)
    head = ", ".join(f"{name} AS MATERIALIZED ({DUCK[name].strip()})" for name in order)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
