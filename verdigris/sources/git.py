"""Files of a git revision, read without a checkout, as a Spark data source named ``git_revision``."""

from __future__ import annotations

import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_SLICE = 64


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


class _Slice(InputPartition):
    def __init__(self, names):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.ref = options.get("repo", "."), options.get("ref", "HEAD")
        self.folder, self.extension = options.get("folder", "."), options.get("extension", ".py")
        self.size = int(options.get("filesPerSlice", FILES_PER_SLICE))

    def partitions(self):
        listing = _git(self.repo, "ls-tree", "-r", "-z", "--name-only", "--full-tree" if self.folder == "." else "--full-name", self.ref, *([] if self.folder == "." else ["--", self.folder]))
        names = [n for n in listing.decode("utf-8", "replace").split("\0") if n.endswith(self.extension) and "\n" not in n]
        return [_Slice(names[i : i + self.size]) for i in range(0, len(names), self.size)]

    def read(self, part):
        asked = "".join(f"{self.ref}:{name}\n" for name in part.names).encode()
        with tempfile.TemporaryFile() as names:  # one process a slice; its input never waits for its output
            names.write(asked)
            names.seek(0)
            with subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=names, stdout=subprocess.PIPE) as git:
                for name in part.names:
                    head = git.stdout.readline().split()
                    if len(head) != 3:
                        raise FileNotFoundError(f"{self.ref}:{name}")
                    text = git.stdout.read(int(head[2]))
                    git.stdout.read(1)
                    yield name, text.decode("utf-8", "replace")


class GitRevision(DataSource):
    """Options: repo (a path every machine has), ref, folder, extension, filesPerSlice."""

    @classmethod
    def name(cls):
        return "git_revision"

    def schema(self):
        return "uid string, text string"

    def reader(self, schema):
        return _Reader(self.options)


def from_git(spark: SparkSession, repo: str = ".", ref: str = "HEAD", folder: str = ".", extension: str = ".py") -> DataFrame:
    """(uid, text) of the files of a revision; one task for each slice of files."""
    spark.dataSource.register(GitRevision)
    return spark.read.format("git_revision").options(repo=repo, ref=ref, folder=folder, extension=extension).load()
