"""How Python workers come by this package."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> None:
    """Python workers find this package: in the driver's folder where all is one process, else in a zip that Spark sends to them, once a context."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if re.match(r"local(\[|$)", sc.master):
        root, env = str(package.parent), sc.environment
        if root not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    elif not getattr(sc, "_sent_package", None):
        # the driver serves the file itself, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="ledgerloom-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc._sent_package = f"{folder}/{package.name}.zip"
        with zipfile.ZipFile(sc._sent_package, "w") as out:
            for module in sorted(package.rglob("*.py")):
                out.write(module, module.relative_to(package.parent))
        sc.addPyFile(sc._sent_package)
