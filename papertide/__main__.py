"""python -m papertide FILE...: prints the text of each file; problems go to standard error and the exit code."""

from __future__ import annotations

import sys
from pathlib import Path


def main(paths: list[str]) -> int:
    if not paths:
        print("usage: python -m papertide FILE...", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from papertide.api import extract

    found, failed = [], False
    for k, path in enumerate(paths):
        try:
            found.append((k, path, Path(path).read_bytes()))
        except OSError as e:
            print(f"papertide: {path}: {e.strerror}", file=sys.stderr)
            failed = True
    if not found:
        return 1
    spark = SparkSession.builder.appName("papertide").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    files = spark.createDataFrame(found, "doc_id int, path string, content binary")
    rows = {r.doc_id: r for r in extract(files.select("doc_id", "content"), by_path=True).select("doc_id", "text", F.col("error")).collect()}
    for k, path, _ in found:
        row = rows[k]
        if row.error is not None:
            print(f"papertide: {path}: {row.error}", file=sys.stderr)
            failed = True
        elif len(paths) > 1:
            print(f"==> {path} <==\n{row.text}")
        else:
            print(row.text, end="")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
