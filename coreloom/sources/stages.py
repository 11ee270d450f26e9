"""Stage results kept under a key of their parameters and input content."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def row_text(columns: Sequence[Column]) -> Column:
    """Columns joined by '|'; callers scale floating-point columns to integers first."""
    return F.concat_ws("|", *[c.cast("string") for c in columns])


def fingerprint(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """One row (rows, digest): independent of row order and partitioning.

    The digest adds the first 32 bits of each row's md5 as an exact decimal, so it
    cannot overflow at any row count.
    """
    number = F.conv(F.substring(F.md5(row_text(columns)), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def feature_fingerprint(df: DataFrame, label: str = "label", scale: int = 1_000_000) -> str:
    """Digest of a feature table as text, for stage keys."""
    cells = F.concat_ws(",", F.transform("features", lambda x: F.round(x * scale).cast("bigint").cast("string")))
    row = fingerprint(df, [cells, F.col(label)]).first()
    return f"{row['rows']}-{row['digest']}"


def _content(columns: Sequence[str]) -> list[Column]:
    """Rows and two 64-bit hash sums over all columns: the same for any order of the rows."""
    whole = [F.col(f"`{c}`") for c in columns]
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*whole).cast("decimal(20,0)")).alias("low"),
        F.sum(F.xxhash64(F.lit("second"), *whole).cast("decimal(20,0)")).alias("high"),
    ]


def _digest(found) -> str:
    return hashlib.md5(f"{found['rows']}|{found['low']}|{found['high']}".encode()).hexdigest()


def content_key(df: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order; one aggregate pass."""
    return _digest(df.agg(*_content(df.columns)).first()) + "".join(f";{c}:{t}" for c, t in df.dtypes)


@dataclass(frozen=True)
class Stage:
    """What the marker of a finished stage says, and its table (None for a fitted model)."""

    name: str
    key: str
    digest: str
    seconds: float
    rows: int | None = None
    note: dict = field(default_factory=dict)
    table: DataFrame | None = None
    reused: bool = False


class Stages:
    """Results under ``<root>/<step>/<key>``; a finished one is reused.

    The key is a digest of the step's parameters, which hold the content digests of its inputs. A result counts as
    finished once its marker ``<key>.done`` is there; the marker is written after the data and holds what later steps
    ask for: rows and content digest (both observed while the table was written), seconds, and a note. A run that
    dies in between leaves no marker, so its step is built again, over what it left.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, step: str, params: dict) -> str:
        return f"{self.root}/{step}/{self.key(params)}"

    @staticmethod
    def key(params: dict) -> str:
        return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()

    _MARKER = "digest string, seconds double, rows bigint, note string"

    def exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _marker(self, step: str, params: dict) -> dict | None:
        path = self.path(step, params) + ".done"
        if not self.exists(path + "/_SUCCESS"):
            return None
        return self.spark.read.schema(self._MARKER).json(path).first().asDict()

    def _finish(self, step: str, params: dict, digest: str, started: float, rows: int | None, note: dict) -> None:
        told = [(digest, time.monotonic() - started, rows, json.dumps(note))]
        marker = self.spark.createDataFrame(told, self._MARKER).coalesce(1)
        marker.write.mode("overwrite").json(self.path(step, params) + ".done")

    def _found(self, step: str, params: dict, reused: bool, read: bool) -> Stage | None:
        marker = self._marker(step, params)
        if marker is None:
            return None
        table = self.spark.read.parquet(self.path(step, params)) if read else None
        told = {**marker, "note": json.loads(marker["note"])}
        return Stage(step, self.key(params), table=table, reused=reused, **told)

    def table(self, step: str, params: dict, build: Callable[[], DataFrame], note: Callable[[], dict] = dict) -> Stage:
        """The step's table, built by ``build`` unless it is there; ``note`` is asked only then."""
        found = self._found(step, params, True, True)
        if found is None:
            started = time.monotonic()
            seen = Observation()
            df = build()
            df.observe(seen, *_content(df.columns)).write.mode("overwrite").parquet(self.path(step, params))
            told = seen.get
            self._finish(step, params, _digest(told), started, told["rows"], note())
            found = self._found(step, params, False, True)
        return found

    def model(self, step: str, params: dict, fit: Callable[[], tuple], load: Callable[[str], object]) -> tuple[object, Stage]:
        """A fitted model and its stage; ``fit`` gives the model and a note. A model's digest is its key."""
        path = self.path(step, params)
        found = self._found(step, params, True, False)
        if found is not None:
            return load(path), found
        started = time.monotonic()
        model, note = fit()
        model.write().overwrite().save(path)
        self._finish(step, params, self.key(params), started, None, note)
        return model, self._found(step, params, False, False)

    def load(self, step: str, params: dict) -> DataFrame | None:
        found = self._found(step, params, True, True)
        return found and found.table

    def get_or_build(self, step: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
        return self.table(step, params, build).table
