"""A connector of JSON lines that reads, writes and takes streams, with commits that survive retries.

A task writes a file of its own name; a commit writes a manifest that names the files of the
tasks that succeeded, and readers see only files in manifests. A lost or repeated task so
leaves at most a file that nothing names. A batch of a stream commits under its number, so
a batch that is run again takes the place of its first run.

A manifest also has each file's least and greatest value of its number and text columns. A
read with the option skip, whose filters Spark passes on (spark.sql.python.filterPushdown.enabled),
skips files that can hold no row of them; Spark still applies the filters to the rows.

Manifests are numbered, and the number is a stream's offset: a batch reads the files of the
commits after the last one, a partition for each file. One writer at a time may commit to a
table that is read as a stream, and a table so read is only appended to.
"""

from __future__ import annotations

import datetime
import io
import json
import math
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

_MANIFEST = re.compile(r"_commit-(\d{12})-(.+)$")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    ends: dict = field(default_factory=dict)


def _folder(path: str):
    """File system and folder of a path or URI, on any system that Arrow can reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    system, base = fs.FileSystem.from_uri(path)
    return system, base.rstrip("/")


def _put(system, name: str, data: bytes) -> None:
    with system.open_output_stream(name) as f:
        f.write(data)


def _manifests(system, base: str) -> list[tuple[int, str, str]]:
    """(number, label, path) of each commit, in order."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((int(m[1]), m[2], x.path) for x in found if (m := _MANIFEST.match(x.base_name)))


def _files(system, manifests) -> list[dict]:
    files = []
    for _, _, path in manifests:
        with system.open_input_stream(path) as f:
            files += json.loads(f.read())
    return files


class LinesDataSource(DataSource):
    """Options: path; skip (true: filters skip files, which needs the setting above). A schema must be given for reading."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self):
        raise ValueError("lines: a schema must be given")

    def reader(self, schema):
        skips = self.options.get("skip", "false").lower() == "true"
        return (SkippingLinesReader if skips else LinesReader)(self.options["path"], schema)

    def writer(self, schema, overwrite: bool):
        return LinesWriter(self.options["path"], overwrite)

    def streamReader(self, schema):
        return LinesStreamReader(self.options["path"], schema)

    def streamWriter(self, schema, overwrite: bool):
        return LinesStreamWriter(self.options["path"])


_PARSE = {"timestamp": datetime.datetime.fromisoformat, "timestamp_ntz": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat}


def _rows(path: str, name: str | None, schema):
    if name is None:
        return
    system, base = _folder(path)
    kinds = [(x.name, _PARSE.get(x.dataType.typeName())) for x in schema.fields]
    with system.open_input_stream(f"{base}/{name}") as f:
        for line in io.BufferedReader(f):
            row = json.loads(line)
            yield tuple(v if (v := row.get(n)) is None or p is None else p(v) for n, p in kinds)


def _can_hold(ends: dict, wanted) -> bool:
    """Whether a file with these ends of its columns may hold a row that a filter lets through."""
    name = wanted.attribute[0]
    if len(wanted.attribute) > 1 or name not in ends:
        return True
    if ends[name] is None:
        return False  # nulls alone, which no comparison lets through
    low, high = ends[name]
    values = wanted.value if isinstance(wanted, In) else (wanted.value,)
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool) or not isinstance(v, str if isinstance(low, str) else (int, float)) or v != v:
            return True  # not comparable here
        if isinstance(wanted, (EqualTo, In)):
            ok = low <= v <= high
        elif isinstance(wanted, (GreaterThan, GreaterThanOrEqual)):
            ok = high > v or (high == v and isinstance(wanted, GreaterThanOrEqual))
        else:
            ok = low < v or (low == v and isinstance(wanted, LessThanOrEqual))
        if ok:
            return True
    return False


class LinesReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema, self.wanted = path, schema, []

    def partitions(self):
        system, base = _folder(self.path)
        files = [x["file"] for x in _files(system, _manifests(system, base)) if all(_can_hold(x["ends"], w) for w in self.wanted)]
        return [InputPartition(x) for x in files] or [InputPartition(None)]

    def read(self, partition):
        return _rows(self.path, partition.value, self.schema)


class SkippingLinesReader(LinesReader):
    """A reader that takes filters: a class of its own, for Spark refuses one where passing filters on is off."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.wanted.append(f)
            yield f  # files are skipped by it, rows are not


class LinesStreamReader(DataSourceStreamReader):
    """Commits as batches; an offset is the number of the last commit that was read."""

    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def initialOffset(self):
        return {"commit": 0}

    def latestOffset(self):
        commits = _manifests(*_folder(self.path))
        return {"commit": commits[-1][0] if commits else 0}

    def partitions(self, start, end):
        system, base = _folder(self.path)
        files = _files(system, [m for m in _manifests(system, base) if start["commit"] < m[0] <= end["commit"]])
        return [InputPartition(x["file"]) for x in files]

    def read(self, partition):
        return _rows(self.path, partition.value, self.schema)


class _Ends:
    """Least and greatest values of the columns of a file that hold numbers or texts alone; None of one without values."""

    def __init__(self):
        self.ends, self.mixed = {}, set()

    def add(self, row: dict) -> None:
        for name, v in row.items():
            if name in self.mixed:
                continue
            if v is None:
                self.ends.setdefault(name, None)
            elif isinstance(v, bool) or not isinstance(v, (int, float, str)) or (isinstance(v, float) and not math.isfinite(v)):
                self.mixed.add(name)
            else:
                seen = self.ends.get(name)
                self.ends[name] = (v, v) if seen is None else (min(seen[0], v), max(seen[1], v))

    def all(self) -> dict:
        return {n: x for n, x in self.ends.items() if n not in self.mixed}


class _Files:
    """What both writers share: a file for each task, a manifest for each commit."""

    path: str

    def write(self, rows) -> Written:
        system, base = _folder(self.path)
        system.create_dir(base, recursive=True)
        name, n, ends = f"part-{uuid.uuid4().hex}.json", 0, _Ends()
        with system.open_output_stream(f"{base}/{name}") as f:
            for row in rows:
                values = row.asDict(recursive=True)
                f.write((json.dumps(values, ensure_ascii=True, default=lambda v: v.isoformat()) + "\n").encode())
                ends.add(values)
                n += 1
        return Written(name, n, ends.all())

    def _publish(self, messages, label: str) -> None:
        """A manifest with the next number; a batch that was committed before keeps its number."""
        system, base = _folder(self.path)
        system.create_dir(base, recursive=True)
        before = _manifests(system, base)
        number = next((n for n, x, _ in before if x == label), before[-1][0] + 1 if before else 1)
        _put(system, f"{base}/_commit-{number:012d}-{label}", json.dumps([{"file": m.file, "rows": m.rows, "ends": m.ends} for m in messages if m is not None and m.rows]).encode())

    def _discard(self, messages) -> None:
        system, base = _folder(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{base}/{m.file}")


class LinesWriter(_Files, DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def commit(self, messages) -> None:
        system, base = _folder(self.path)
        before = _manifests(system, base) if self.overwrite else []
        self._publish(messages, uuid.uuid4().hex)
        for _, _, path in before:
            system.delete_file(path)

    def abort(self, messages) -> None:
        self._discard(messages)


class LinesStreamWriter(_Files, DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def commit(self, messages, batchId: int) -> None:
        self._publish(messages, f"batch-{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self._discard(messages)
