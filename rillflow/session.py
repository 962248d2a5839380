"""SparkSession with the settings every operator of the library assumes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests, benches and notebooks; on a cluster, spark-submit's settings take precedence."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    spark = SparkSession.builder.master(master).appName("rillflow").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that functions in it can run there whatever their search path."""
    context = spark.sparkContext
    if not getattr(context, "_rillflow_shipped", False):
        top = Path(__file__).resolve().parent
        place = Path(tempfile.mkdtemp(prefix="rillflow-code-")) / "rillflow.zip"
        with zipfile.ZipFile(place, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, path.relative_to(top.parent))
        context.addPyFile(str(place))
        context._rillflow_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as this application has it. On one machine without that setting a folder is made; on a cluster it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rillflow-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with the lineage cut: checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, removed at the end."""
    place = f"{shared_folder(spark)}/scratch-{uuid.uuid4()}"
    try:
        yield place
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
