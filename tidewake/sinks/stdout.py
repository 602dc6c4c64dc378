"""Messages to standard output."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame


class Stdout:
    """Prints messages in order, a row at a time from the executors' results."""

    def __init__(self, out=None):
        self.out = out or sys.stdout

    def __call__(self, rows: DataFrame) -> None:
        for row in rows.select("msg").toLocalIterator():
            self.out.write(row["msg"])
            if not row["msg"].endswith("\n"):
                self.out.write("\n")
