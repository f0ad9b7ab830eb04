"""Unified diffs as a table of hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
HUNKS = "key {key}, file_no int, hunk_no int, source_path string, target_path string, source_start int, source_length int, target_start int, target_length int, source_text string, target_text string"


def _path(line: str) -> str | None:
    name = line[4:].split("\t")[0].strip()
    if name == "/dev/null":
        return None
    return name[2:] if name[:2] in ("a/", "b/") else name.removeprefix("./")


def parse(diff: str | None) -> list[tuple]:
    """(file_no, hunk_no, source and target path, ranges and texts) of each hunk; text outside files and hunks is skipped.

    A hunk that ends early keeps the lengths of its header. Lines end in LF or CRLF.
    """
    out: list[tuple] = []
    file_no, hunk_no, source, target = -1, 0, None, None
    lines = (diff or "").replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            source, target, file_no, hunk_no, i = _path(line), _path(lines[i + 1]), file_no + 1, 0, i + 2
            continue
        m = _HUNK.match(line)
        i += 1
        if not m or file_no < 0:
            continue
        a, n, b, k = (int(x) if x else 1 for x in m.groups())
        old, new = [], []
        while i < len(lines) and (len(old) < n or len(new) < k):
            sign, body = lines[i][:1], lines[i][1:]
            if sign == "\\":
                i += 1
                continue
            if sign not in (" ", "", "-", "+"):
                break
            if sign != "+":
                old.append(body)
            if sign != "-":
                new.append(body)
            i += 1
        out.append((file_no, hunk_no, source, target, a, n, b, k, "\n".join(old), "\n".join(new)))
        hunk_no += 1
    return out


def hunks(df: DataFrame, key: str, diff: str) -> DataFrame:
    """One row per hunk of each diff; null and empty diffs have none."""
    schema = HUNKS.format(key=df.schema[key].dataType.simpleString())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(k, *h) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in parse(d)]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ["key", "file_no", "hunk_no", "source_path", "target_path", "source_start", "source_length", "target_start", "target_length", "source_text", "target_text"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in own], t) for c, t in enumerate(kinds)], names=names)

    return df.select(F.col(key).alias("key"), F.col(diff).alias("diff")).mapInArrow(rows, schema)


def headers(diff: Column) -> Column:
    """All hunk headers of a diff, inside the JVM."""
    return F.regexp_extract_all(diff, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), F.lit(0))
