"""A Python data source that writes mask images, one file a slice: ``mask_files``.

A row's png goes to ``<root>/model=<model>/subject=<subject>/slice_<z>_pred.png``, in folders for whichever of the key
columns there are; names are percent-encoded. Tasks write below a folder of their own beside the result. Only when all
have ended are the files of those that succeeded moved to their places, so failed or repeated tasks leave none behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .chunks import opened

#: A null key, as Spark's own partition folders have it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class WrittenImages(WriterCommitMessage):
    """A task's folder, and its files in it."""

    folder: str
    files: list[str]


class MaskWriter(DataSourceWriter):
    def __init__(self, root: str, keys: list[str], overwrite: bool):
        self.root, self.keys, self.overwrite = root.rstrip("/"), keys, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def place(self, row: Row) -> str:
        told = lambda v: NO_VALUE if v is None else quote(str(v), safe="")
        return "/".join([*(f"{k}={told(row[k])}" for k in self.keys), f"slice_{row['z']:04d}_pred.png"])

    def write(self, iterator: Iterator[Row]) -> WrittenImages:
        fs, top = opened(self.root)
        folder, files, made = f"{self.staging}/{uuid.uuid4().hex}", [], set()
        for row in iterator:
            if row["z"] is None or row["png"] is None:
                raise ValueError("a mask file needs z and png")
            at = self.place(row)
            parent = f"{top}/{folder}/{at}".rsplit("/", 1)[0]
            if parent not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            with fs.open_output_stream(f"{top}/{folder}/{at}") as stream:
                stream.write(bytes(row["png"]))
            files.append(at)
        return WrittenImages(folder, files)

    def commit(self, messages: list[WrittenImages | None]) -> None:
        """Nothing is moved before all names are known to be free and different."""
        fs, top = opened(self.root)
        moves = [(f"{top}/{m.folder}/{at}", f"{top}/{at}") for m in messages if m is not None for at in m.files]
        places = [to for _, to in moves]
        if len(set(places)) < len(places):
            raise ValueError("two rows have the same place: keys and z must be unique")
        if not self.overwrite and places:
            taken = [i.path for i in fs.get_file_info(places) if i.type != pa.fs.FileType.NotFound]
            if taken:
                raise FileExistsError(f"{len(taken)} files are there already, such as {taken[0]}")
        for parent in {to.rsplit("/", 1)[0] for to in places}:
            fs.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: fs.move(*m), moves))
        self._clear()

    def abort(self, messages: list[WrittenImages | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, top = opened(self.root)
        if fs.get_file_info(f"{top}/{self.staging}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{top}/{self.staging}")


class MaskFiles(DataSource):
    """Sink of rows (any of model and subject, z int, png binary); option ``keys`` names the folders, in order.

    Mode ``append`` refuses to touch a file that is there, ``overwrite`` replaces it; other files stay in both."""

    @classmethod
    def name(cls) -> str:
        return "mask_files"

    def writer(self, schema: StructType, overwrite: bool) -> MaskWriter:
        given = [k for k in self.options.get("keys", "model,subject").split(",") if k]
        missing = {"z", "png"} - set(schema.names)
        if missing:
            raise ValueError(f"mask files need the columns {sorted(missing)}")
        return MaskWriter(self.options["path"], [k for k in given if k in schema.names], overwrite)
