"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: functions that run there import it, and the
    path of the driver's Python is not theirs."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerprep_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ledgerprep-")) / "ledgerprep.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._ledgerprep_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as ``spark.checkpoint.dir`` names it.

    A folder of our own is set only where the session names none and the master is local,
    because executors of a cluster cannot see a folder of the driver machine.
    """
    sc = spark.sparkContext
    ship(spark)
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="ledgerprep-"))
    return sc.getCheckpointDir()


# Wide projections of this library make generated methods the JVM would not compile at all
# above this size; Spark then generates them in smaller pieces.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Set what the plans of this library run best with, where the session says nothing else."""
    ship(spark)
    for key, value in TUNING.items():
        if key not in dict(spark.sparkContext.getConf().getAll()):
            spark.conf.set(key, value)
    return spark


class Scratch:
    """Intermediate tables of one run, in a folder of its own below the shared folder.

    ``drop`` deletes the folder through Hadoop's file system, so it works for any store. What a
    lazy result still reads must stay until the result is written; a scratch that nobody drops
    goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._count = 0
        self._places: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self.drop)

    def path(self) -> str:
        self._count += 1
        return f"{self.folder}/{self._count:04d}"

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write ``df`` once and go on from the written table."""
        path = self.path()
        df.write.option("compression", codec).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._places[id(kept)] = (kept, path)
        return kept

    def forget(self, kept: DataFrame) -> None:
        """Delete one table this scratch wrote, when nothing reads it any more."""
        _, path = self._places.pop(id(kept))
        self._delete(path)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of jobs that are done.

        It does so when the driver's JVM finds that nothing refers to them any more, which with a small
        heap in use may be long after: a run of many rounds would keep the files of all."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        atexit.unregister(self.drop)
        self._places.clear()
        try:
            self._delete(self.folder)
        except Exception:  # noqa: BLE001  the session has ended before
            pass

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Later readers neither recompute it nor depend on the executors that made it, read only the
    columns they need, and Spark knows its true size when it picks a join. The copies of a session lie
    in one folder, which goes when the driver ends or with ``drop_cuts``."""
    sc = df.sparkSession.sparkContext
    if getattr(sc, "_ledgerprep_cuts", None) is None:
        sc._ledgerprep_cuts = Scratch(df.sparkSession)
    return sc._ledgerprep_cuts.keep(df)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all copies ``cut`` made in this session: for a long one, when its results are written."""
    scratch = getattr(spark.sparkContext, "_ledgerprep_cuts", None)
    if scratch is not None:
        scratch.drop()
        spark.sparkContext._ledgerprep_cuts = None
