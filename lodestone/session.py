"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings every plan of this package assumes; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "*", app: str = "lodestone", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    make_importable(spark)
    return spark


def make_importable(spark: SparkSession) -> None:
    """Lets the Python workers import this package wherever the driver was started from.

    The package's folder joins the workers' path; a cluster also gets a zip of the package, as its machines may not have the folder.
    """
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parents[1])
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([root, *[p for p in paths if p]])
    if not context.master.startswith("local"):
        target = Path(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(Path(root, "lodestone").rglob("*.py")):
                z.write(f, f.relative_to(root))
        context.addPyFile(str(target))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir`` and that one is used. Only where nothing is set, as in
    a local test, a temporary folder is made, which goes with the process; a cluster must never rely on that branch. Checkpoints that nothing
    refers to any more are removed where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, which a cluster should set.
    """
    context = spark.sparkContext
    jvm_dir = context._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.environ.get("LODESTONE_CHECKPOINT_DIR")
        if not named:
            named = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named
