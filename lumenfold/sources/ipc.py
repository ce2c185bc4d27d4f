"""A Spark data source that writes Arrow IPC files."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class IpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenfold_ipc"

    def writer(self, schema, overwrite):
        return IpcWriter(self.options["path"], self.options.get("compression") or None)


class IpcWriter(DataSourceArrowWriter):
    """Each task writes one file under a name of its own; only committed tasks' files stay."""

    def __init__(self, path: str, compression: str | None):
        self.path, self.compression = path, compression

    def write(self, batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        system.create_dir(root)
        name, out, rows = f"{root}/part-{uuid.uuid4().hex}.arrow", None, 0
        for b in batches:
            if out is None:
                sink = system.open_output_stream(name)
                out = pa.ipc.new_file(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=self.compression))
            out.write_batch(b)
            rows += b.num_rows
        if out is not None:
            out.close()
            sink.close()
        return Written(name if rows else "")

    def commit(self, messages):
        pass

    def abort(self, messages):
        from pyarrow import fs

        for m in messages:
            if m and m.name:
                system = fs.LocalFileSystem() if "://" not in self.path else fs.FileSystem.from_uri(self.path)[0]
                system.delete_file(m.name)


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name
