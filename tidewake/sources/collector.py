"""Log files as records: which files, what their paths say, and how their lines are read."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.kvtext import tag_line_column
from .files import LogFiles
from .parsers import parser


@dataclass
class PathSchema:
    """Tags and fields of files whose path matches; `{name}` in a value is the group of that name."""

    path: str
    tags: dict[str, str]
    fields: dict[str, str] = field(default_factory=dict)
    fmt: str = "pure"
    date_patterns: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)

    @property
    def groups(self) -> dict[str, int]:
        return dict(re.compile(self.path).groupindex)

    def java_path(self) -> str:
        return re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1]}>", self.path)

    def filled(self, template: str, path: Column) -> Column:
        """A template with the groups of the path put in."""
        out = F.lit(template)
        for name, k in self.groups.items():
            if "{" + name + "}" in template:
                out = F.replace(out, F.lit("{" + name + "}"), F.regexp_extract(path, self.java_path(), k))
        return out


@dataclass
class Collector:
    """Which files are read; the first schema that matches a path counts."""

    include: list[str]
    schemas: list[PathSchema]
    exclude: list[str] = field(default_factory=list)
    max_line: int = 16384

    def options(self) -> dict[str, str]:
        return {"include": json.dumps(self.include), "exclude": json.dumps(self.exclude), "max_line": str(self.max_line)}

    def lines(self, spark: SparkSession) -> DataFrame:
        """file, line_no (where the line begins in its file) and line, its line feed kept; lines over max_line are split there."""
        spark.dataSource.register(LogFiles)
        return spark.read.format(LogFiles.name()).options(**self.options()).load()

    def split_lines(self, spark: SparkSession) -> DataFrame:
        """As `lines` for a batch, with large files split among tasks.

        line_no only tells lines apart here, so this is for formats whose lines stand alone (all but
        text). The last line of a file gets a line feed even where the file has none.
        """
        rows = spark.read.text(self.include).select(F.regexp_replace("_metadata.file_path", r"\A[a-z]+:/+", "/").alias("file"), F.col("value"))
        for pattern in self.exclude:
            rows = rows.filter(~F.col("file").rlike(pattern))
        return rows.select("file", F.monotonically_increasing_id().alias("line_no"), F.concat("value", F.lit("\n")).alias("line"))

    def read(self, lines: DataFrame) -> DataFrame:
        """Lines as records with tags, tag_line and fields; lines of files without a schema are left out, unreadable ones marked."""
        out, before = None, F.lit(False)
        for s in self.schemas:
            mine = F.col("file").rlike(s.java_path()) & ~before
            before = before | F.col("file").rlike(s.java_path())
            parsed = parser(s.fmt, s.date_patterns, s.keys)(lines.filter(mine))
            tags = F.create_map(*(x for k, v in s.tags.items() for x in (F.lit(k), s.filled(v, F.col("file")))))
            extra = F.array(*(F.struct(F.lit(k).alias("k"), s.filled(v, F.col("file")).alias("v")) for k, v in s.fields.items())) if s.fields else F.array()
            # The fields of the file come before those of the line.
            rows = parsed.withColumn("tags", tags).withColumn("fields_kv", F.concat(extra.cast("array<struct<k:string,v:string>>"), F.col("fields_kv")))
            out = rows if out is None else out.unionByName(rows)
        return out.withColumn("tag_line", tag_line_column(F.col("tags")))
