"""A sink for text in order: parts written by tasks, and one manifest that names them in order.

Every task writes its lines to a part of a new name.  When all tasks are done the
driver writes the heading's part and then puts the manifest in its place, in one
move; until then readers see what was there before, and a job that fails takes
its parts away.  A part of an attempt that was lost stands in no manifest.  The
parts' order is that of the partitions, so sorted rows stay sorted, and a heading
is there where there are no rows.

Files are opened through ``pyarrow.fs`` by path or URI.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


def _place(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def manifest(path: str) -> dict:
    """What a folder holds: ``parts``, each with name, rows and bytes in order; nothing is there where none was written."""
    system, inner = _place(path)
    if not system.get_file_info(f"{inner}/{MANIFEST}").is_file:
        return {"parts": []}
    with system.open_input_stream(f"{inner}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    bytes: int


class Writer(DataSourceArrowWriter):
    """One job's parts, all named after its run."""

    def __init__(self, path: str, heading: list[str], overwrite: bool):
        self.path, self.heading, self.overwrite, self.run = path, heading, overwrite, uuid.uuid4().hex

    def _part(self, name: str, batches) -> tuple[int, int]:
        """(rows, bytes) of a part of lines; a null line is an empty one."""
        system, inner = _place(self.path)
        rows = size = 0
        with system.open_output_stream(f"{inner}/{name}") as out:
            for batch in batches:
                if len(batch):
                    text = "\n".join(pc.fill_null(batch.column(0).cast(pa.string()), "").to_pylist()) + "\n"
                    size += out.write(text.encode("utf-8", "surrogatepass"))
                    rows += len(batch)
        return rows, size

    def write(self, iterator):
        partition = TaskContext.get().partitionId()
        name = f"part-{self.run}-{partition + 1:06d}-{uuid.uuid4().hex[:8]}.txt"
        return Part(partition, name, *self._part(name, iterator))

    def _mine(self, names) -> list[str]:
        """Parts of this run with other names than those."""
        from pyarrow import fs

        system, inner = _place(self.path)
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return [f.path for f in found if f.is_file and f.base_name.startswith(f"part-{self.run}-") and f.base_name not in names]

    def commit(self, messages):
        system, inner = _place(self.path)
        before = manifest(self.path)["parts"]
        parts = [{"name": m.name, "rows": m.rows, "bytes": m.bytes} for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.rows]
        if self.heading and (self.overwrite or not before):
            name = f"part-{self.run}-{0:06d}-heading.txt"
            rows, size = self._part(name, [pa.record_batch([pa.array(self.heading, pa.string())], ["value"])])
            parts = [{"name": name, "rows": rows, "bytes": size, "heading": True}, *parts]
        kept = [*([] if self.overwrite else before), *parts]
        coming = f"{inner}/_{self.run}.json"
        with system.open_output_stream(coming) as out:
            out.write(json.dumps({"parts": kept}).encode())
        system.move(coming, f"{inner}/{MANIFEST}")
        gone = self._mine({p["name"] for p in parts}) + ([f"{inner}/{p['name']}" for p in before] if self.overwrite else [])
        for name in gone:
            if system.get_file_info(name).is_file:
                system.delete_file(name)

    def abort(self, messages):
        system, _ = _place(self.path)
        for name in self._mine(()):
            system.delete_file(name)


class OrderedText(DataSource):
    """``df.write.format("ordered_text")`` of one text column, with the option heading (a JSON list of lines)."""

    @classmethod
    def name(cls):
        return "ordered_text"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        if len(schema.fields) != 1:
            raise ValueError("a line is one column")
        system, inner = _place(self.options["path"])
        system.create_dir(inner, recursive=True)
        return Writer(self.options["path"], json.loads(self.options.get("heading", "[]")), overwrite)


def write(lines: DataFrame, path: str, heading: list[str] | None = None, mode: str = "overwrite") -> None:
    """The lines (one text column, in the order of its partitions) under a heading.

    ``overwrite`` puts them in the place of what is there once all are written;
    ``append`` adds them after it, without a second heading.
    """
    spark = lines.sparkSession
    spark.dataSource.register(OrderedText)
    lines.write.format("ordered_text").option("heading", json.dumps(heading or [])).mode(mode).save(path)


def parts(path: str) -> list[str]:
    """The files to put one after another, in order."""
    return [f"{path.rstrip('/')}/{p['name']}" for p in manifest(path)["parts"]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) without the heading; empty where none were written."""
    named = [f"{path.rstrip('/')}/{p['name']}" for p in manifest(path)["parts"] if not p.get("heading")]
    return spark.read.text(named) if named else spark.createDataFrame([], "value string")
