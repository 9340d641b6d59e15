"""What streams keep between batches: shared folders, versioned snapshots, tables of additive parts.

Everything is plain Parquet under a folder that driver and executors share, read
and written through Spark and its file systems, so it may lie in any store.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where executors are threads of the driver and it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="tidewell-streams-")
    sc.setCheckpointDir(folder)
    return folder


class Files:
    """A folder in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def swap_in(self, name: str, text: str) -> None:
        """Write ``text`` under another name and rename it, so that readers meet the whole of it or none."""
        whole = f"{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(whole))
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name):
            self.remove(name)
        if not self._fs.rename(self._at(whole), self._at(name)):
            raise OSError(f"can't rename {whole} to {name}")

    def set_time(self, name: str, millis: int) -> None:
        self._fs.setTimes(self._at(name), millis, -1)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, gone when the Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def gone():
        with contextlib.suppress(Exception):
            Files(spark, path).remove()

    atexit.register(gone)
    return path


class Damaged(Exception):
    """Versions are there but none of them is whole; starting anew would lose them."""


class Snapshots:
    """Versions of a table, of which the newest whole one counts.

    A version's rows are written first and its manifest is swapped in last, so a
    writer that dies leaves the versions before it as they were. The manifest holds
    the schema, the number of rows and a digest of them; a version whose files are
    missing, unreadable or give other rows is refused on reading and the one before
    it is read. Writing a version again that is whole changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path, max(2, keep)
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        """Versions with a manifest, newest first."""
        return sorted((int(n) for n in self.files.names("manifests") if n.isdigit()), reverse=True)

    @staticmethod
    def _digest(df: DataFrame) -> list:
        """The number of rows and two sums of their hashes, whatever their order."""
        h = F.xxhash64(*df.columns) if df.columns else F.lit(0)
        row = df.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(2**31))), F.lit(0))).first()
        return list(row)

    def sound(self, version: int) -> DataFrame | None:
        """The rows of a version, or None where it isn't whole."""
        try:
            told = json.loads(self.files.read(f"manifests/{version:012d}"))
            df = self.spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{self.path}/data/{told['data']}")
            return df if self._digest(df) == told["digest"] else None
        except Exception:  # whatever a store or reader says of broken files
            return None

    def read(self) -> tuple[int, DataFrame] | None:
        """(version, rows) of the newest whole version; None where there is none at all."""
        known = self.versions()
        for v in known:
            df = self.sound(v)
            if df is not None:
                return v, df
        if known:
            raise Damaged(f"none of the versions {known} of {self.path} is whole")
        return None

    def write(self, df: DataFrame, version: int) -> bool:
        """Add ``df`` as ``version``; False where that or a later whole one is there already."""
        known = self.versions()
        if any(v >= version and self.sound(v) is not None for v in known if v >= version):
            return False
        data = f"{version:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{data}")
        whole = self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{data}")
        self.files.swap_in(f"manifests/{version:012d}", json.dumps({"data": data, "schema": json.loads(df.schema.json()), "digest": self._digest(whole)}))
        self._tidy()
        return True

    def _tidy(self) -> None:
        """Drop all but the newest ``keep`` versions, and data that no manifest names and that is older than these."""
        kept = self.versions()[: self.keep]
        for v in self.versions()[self.keep :]:
            self.files.remove(f"manifests/{v:012d}")
        for name in self.files.names("data"):
            if int(name[:12]) < min(kept):
                self.files.remove(f"data/{name}")


class Parts:
    """A table of what each batch adds, one folder a batch: a batch that is run again replaces its own part and adds nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path
        known = spark.createDataFrame([], schema).schema
        self.schema = StructType([*known.fields, StructField("batch", LongType())])

    def put(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self, before: int | None = None) -> DataFrame:
        """All parts with their ``batch``, or those of batches ``before`` one."""
        if not Files(self.spark, self.path).names():
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).parquet(self.path)
        return df if before is None else df.filter(F.col("batch") < before)


def in_batches(df: DataFrame, order: str, n: int, path: str) -> DataFrame:
    """A stream of the rows of ``df`` in ``n`` batches at most, by ``order``: files written once, read one a batch in the order of their times."""
    spark = df.sparkSession
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)
    files = Files(spark, path)
    for i, name in enumerate(x for x in files.names() if x.startswith("part-")):
        files.set_time(name, 1_700_000_000_000 + 60_000 * i)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
