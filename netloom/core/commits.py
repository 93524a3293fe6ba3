"""State that changes as a whole: numbered files in a folder, of which the last one counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

#: Earlier commits that stay, for readers that are slow and for the curious.
KEPT = 3


class Commits:
    """Commits under one folder. Each holds the whole state, so reading lists a few files however many were made."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def fs(self):
        return self.path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        fs, at = self.fs(), self.path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _files(self) -> list[str]:
        return [n for n in self.names("commits") if n.endswith(".json")]

    def last(self) -> tuple[int, dict | None]:
        """Number and state of the last commit; 0 and None before the first."""
        files = self._files()
        if not files:
            return 0, None
        stream = self.fs().open(self.path(f"commits/{files[-1]}"))
        try:
            return int(files[-1].split(".")[0]), json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> bool:
        """Make commit `number`; False if there is one already. The file appears complete or not at all."""
        fs, temp, to = self.fs(), self.path(f"pending-{number}.json"), self.path(f"commits/{number:012d}.json")
        if fs.exists(to):
            return False
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(self.path("commits"))
        if not fs.rename(temp, to):
            return False
        for old in self._files()[:-KEPT]:
            fs.delete(self.path(f"commits/{old}"), False)
        return True
