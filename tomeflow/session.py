"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "tomeflow", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Nothing is done where the workers start in, or have on PYTHONPATH, the folder that holds the
    package; otherwise the sources are sent with ``addPyFile``, once per application.
    """
    root = PACKAGE.parent
    seen = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(":")} | {Path.cwd()}
    app = spark.sparkContext.applicationId
    if root in seen or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="tomeflow-")) / "tomeflow.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in PACKAGE.rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that its lineage ends here.

    The folder is the session's own ``spark.checkpoint.dir``. Without one, a session whose tasks all
    run in this process, as in tests, gets a folder of this process; any other is refused, as no
    folder of one machine outlives an executor.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tomeflow-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
