"""Picture folders as a Spark data source: a partition per folder, each listed by a task.

Planning walks directories down to those that hold pictures and names the folders; files are listed where the task runs, a folder
at a time, and never reach the driver. Storage is whatever pyarrow's file systems open (local, HDFS, object stores).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "category string, kind string, stem string, path string"


def opened(root: str):
    """File system and path of a URI or an absolute path."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", root)
    return fs.FileSystem.from_uri(f"file://{quote(local)}" if local.startswith("/") else root)


class Folder(InputPartition):
    def __init__(self, category: str, kind: str, path: str, suffix: str):
        self.category, self.kind, self.path, self.suffix = category, kind, path, suffix


class PictureReader(DataSourceReader):
    def __init__(self, root: str, kinds: Mapping[str, tuple[str, str]]):
        self.root, self.kinds = root, kinds

    def partitions(self) -> list[Folder]:
        """The folders of all kinds, below the directory that is their category."""
        from pyarrow import fs

        files, top = opened(self.root)
        found: list[Folder] = []
        todo = [top]
        while todo:
            here = todo.pop()
            below = [x for x in files.get_file_info(fs.FileSelector(here)) if x.type == fs.FileType.Directory]
            wanted = files.get_file_info([f"{here}/{folder}" for folder, _ in self.kinds.values()])
            own = [(kind, suffix, x.path) for (kind, (_, suffix)), x in zip(self.kinds.items(), wanted, strict=True) if x.type == fs.FileType.Directory]
            found += [Folder(here.rstrip("/").rsplit("/", 1)[-1], kind, path, suffix) for kind, suffix, path in own]
            taken = {path.removeprefix(f"{here}/").split("/")[0] for _, _, path in own}
            todo += [x.path for x in below if x.base_name not in taken]
        return found or [Folder("", "", "", "")]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.path:
            return
        files, _ = opened(self.root)
        ending = f".{partition.suffix}"
        for x in files.get_file_info(fs.FileSelector(partition.path)):
            if x.type == fs.FileType.File and x.base_name.endswith(ending):
                yield partition.category, partition.kind, x.base_name.removesuffix(ending), x.path


class PictureListing(DataSource):
    """`spark.read.format("picture_folders").option("kinds", json of {kind: [folder, suffix]}).load(root)`"""

    @classmethod
    def name(cls) -> str:
        return "picture_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PictureReader:
        kinds = {kind: tuple(place) for kind, place in json.loads(self.options["kinds"]).items()}
        return PictureReader(self.options["path"], kinds)


def picture_files(spark: SparkSession, root: str, kinds: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(category, kind, stem, path) of the pictures below `root`; `kinds` gives folder and suffix of each kind."""
    spark.dataSource.register(PictureListing)
    return spark.read.format(PictureListing.name()).option("kinds", json.dumps(kinds)).load(root)
