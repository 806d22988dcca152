"""The whole and the redacted export from one pass, both or neither."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyarrow import RecordBatch
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from plotwright import schemas
from plotwright.sources.tables import rendered

#: Bytes of text that a task holds before it writes them.
HELD = 1 << 20


@dataclass
class Parts(WriterCommitMessage):
    """The files of one task, and its rows."""

    names: list[str] = field(default_factory=list)
    rows: int = 0


class TwoExports(DataSource):
    """``df.write.format("two-exports")`` with the options ``path`` (a folder that all machines share), ``hidden`` (JSON list of columns) and ``names`` (JSON list: the columns, where the frame's are the finished lines of both files)."""

    @classmethod
    def name(cls) -> str:
        return "two-exports"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        hidden, names = json.loads(self.options.get("hidden", "[]")), self.options.get("names")
        return TwoWriter(self.options["path"], schema.names, hidden, overwrite) if names is None else LineWriter(self.options["path"], json.loads(names), hidden, overwrite)


class TwoWriter(DataSourceWriter):
    """Tasks write their rows to ``full`` and ``public`` in a folder beside the target; the commit leaves there what committed tasks wrote and renames it, once for both."""

    def __init__(self, path: str, names: list[str], hidden: list[str], overwrite: bool):
        self.path, self.names, self.hidden, self.overwrite = path, names, set(hidden), overwrite
        self.staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Parts:
        show = [c not in self.hidden for c in self.names]
        cells = (["" if v is None else v for v in row] for row in iterator)
        return self.put((self.line(row), self.line([v if s else "" for v, s in zip(row, show, strict=True)]), 1) for row in cells)

    @staticmethod
    def line(cells: Sequence[str]) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n").writerow(cells)
        return out.getvalue()

    def put(self, texts: Iterator[tuple[str, str, int]]) -> Parts:
        """Writes a file of each kind: the header, then the texts (of both kinds, and their rows)."""
        fs, staged = FileSystem.from_uri(self.staged)
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.csv"
        rows, streams, head = 0, [], self.line(self.names)
        held, size = ([head], [head]), 0

        def flush() -> None:
            for lines, stream in zip(held, streams, strict=True):
                stream.write("".join(lines).encode())
                lines.clear()

        try:
            for kind in ("full", "public"):
                fs.create_dir(f"{staged}/{kind}")
                streams.append(fs.open_output_stream(f"{staged}/{kind}/{part}"))
            for full, public, n in texts:
                held[0].append(full)
                held[1].append(public)
                rows, size = rows + n, size + len(full)
                if size >= HELD:
                    flush()
                    size = 0
            flush()
        finally:
            for stream in streams:
                stream.close()
        return Parts([part], rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staged = FileSystem.from_uri(self.staged)
        target = FileSystem.from_uri(self.path)[1]
        kept = {n for m in messages if m is not None for n in m.names}
        for kind in ("full", "public"):
            fs.create_dir(f"{staged}/{kind}")
            for f in fs.get_file_info(FileSelector(f"{staged}/{kind}")):
                if f.base_name not in kept:  # of an attempt that did not commit
                    fs.delete_file(f.path)
        if fs.get_file_info(target).type != FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            fs.delete_dir(target)
        fs.move(staged, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staged = FileSystem.from_uri(self.staged)
        if fs.get_file_info(staged).type != FileType.NotFound:
            fs.delete_dir(staged)


class LineWriter(TwoWriter, DataSourceArrowWriter):
    """The same for rows (line of ``full``, line of ``public``), batch by batch."""

    def write(self, iterator: Iterator[RecordBatch]) -> Parts:
        return self.put(("".join(b.column(0).to_pylist()), "".join(b.column(1).to_pylist()), b.num_rows) for b in iterator)


def quoted(cell: Column) -> Column:
    """Quotes where a cell needs them, as Python's writer sets them."""
    return F.when(cell.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


#: Types whose text never needs quotes.
PLAIN = {"double", "float", "boolean", "date", "tinyint", "smallint", "int", "bigint"}


def lines(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """(full, public): each row as a line of both files."""
    whole = rendered(df)
    cells = whole.select(*[(F.col(f"`{c}`") if kind in PLAIN else quoted(F.col(f"`{c}`"))).alias(c) for c, kind in df.dtypes])
    end = F.lit("\r\n")
    if len(cells.columns) == 1:  # an empty line would be no row
        end = F.concat(F.lit('""'), end)
        one = F.col(f"`{cells.columns[0]}`")
        full = F.when(one == "", end).otherwise(F.concat(one, F.lit("\r\n")))
        return cells.select(full.alias("full"), (end if cells.columns[0] in hidden else full).alias("public"))
    shown = [[F.lit("") if c in out else F.col(f"`{c}`") for c in cells.columns] for out in ((), set(hidden))]
    return cells.select(*[F.concat(F.concat_ws(",", *columns), end).alias(kind) for kind, columns in zip(("full", "public"), shown, strict=True)])


def export(df: DataFrame, folder: str, hidden: Sequence[str] = schemas.OWNER_COLUMNS, order: str = "unique_id", single: bool = True) -> None:
    """``folder/full`` and ``folder/public``, in one job: headed CSV, the second with ``hidden`` blank. Replaces the folder. ``single``: one file each, in order; else one for each range of the order."""
    df.sparkSession.dataSource.register(TwoExports)
    dealt = df.repartition(1) if single else df.repartitionByRange(order)
    lines(dealt.sortWithinPartitions(order), hidden).write.format("two-exports").option("names", json.dumps(df.columns)).mode("overwrite").save(folder)
