"""PySpark-native operators for genome-scale tables and sequences, and for training data."""

from __future__ import annotations


def ship(spark) -> None:
    """Sends the package to Python workers that do not have it installed (a zip of a few hundred KB)."""
    import tempfile
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "locusflow.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
