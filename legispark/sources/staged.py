"""Tables that are loaded in stages and change by commits: stage, validate, merge, commit.

A table is a folder with hash parts by key, each part a folder of one generation, and numbered commits that say which
generation every part has. A load stages its rows aside, checks them, and merges them into new folders of the parts that
they touch; nothing that a reader sees has changed then. The commit is a file under the next number that must not exist: of
two loads that began from the same commit one makes it and the other is told. A load that dies leaves folders that no commit
names. Readers read the folders of one commit, so they see whole tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legispark.operators.load import first_by
from legispark.sources.indexes import _path, read_text

PARTS = 16


class LostCommit(RuntimeError):
    """Another load was committed since this one began."""


class InvalidStage(ValueError):
    """Rows that do not pass the checks: a message for each that fails."""


@dataclass(frozen=True)
class Stage:
    """A load under way: the commit that it began from, the folder of its rows, and the folders it has merged."""

    base: int
    folder: str
    merged: tuple[tuple[int, str], ...] = ()


class StagedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, parts: int = PARTS):
        self.spark, self.path, self.schema, self.key, self.parts = spark, path, schema, key, parts

    def commits(self) -> list[int]:
        """The numbers of all commits, ascending."""
        files, at = _path(self.spark, f"{self.path}/commits/*.json")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in files.globStatus(at) or [])

    def state(self, number: int | None = None) -> tuple[int, dict[int, str]]:
        """A commit, by default the last, and the folder of each part; 0 and none before the first."""
        numbers = self.commits()
        if not numbers and number is None:
            return 0, {}
        number = numbers[-1] if number is None else number
        text = read_text(self.spark, f"{self.path}/commits/{number}.json")
        return number, {int(k): v for k, v in json.loads(text)["parts"].items()}

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of a commit, by default the last."""
        folders = [f"{self.path}/{f}" for f in self.state(number)[1].values()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def stage(self, rows: DataFrame) -> Stage:
        """Writes rows aside, under the schema of the table."""
        folder = f"staged/{uuid.uuid4().hex[:12]}"
        cast = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        cast.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return Stage(self.state()[0], folder)

    def staged(self, stage: Stage) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{stage.folder}")

    def validate(self, stage: Stage, checks: Mapping[str, Column]) -> dict[str, int]:
        """Counts, in one pass, the staged rows that break each check (a condition that must hold); an error tells all that do.

        A key that is null is always wrong. Rows that repeat a key are merged, the last by ``order`` of ``merge`` stands.
        """
        rules = {"key": F.col(self.key).isNotNull()} | dict(checks)
        row = self.staged(stage).agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items())).first()
        broken = {n: row[n] for n in rules if row[n]}
        if broken:
            raise InvalidStage(", ".join(f"{n}: {k}" for n, k in broken.items()))
        return {n: 0 for n in rules}

    def merge(self, stage: Stage, order: Column, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Stage:
        """Writes new folders of the parts that the staged rows touch, merged with what the base commit has of them.

        By default the first row of a key in ``order`` among staged rows replaces the old one; ``combine`` (old, new) makes
        another table of both, for instance one of the upserts of ``operators/load.py``.
        """
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        new = first_by(self.staged(stage), [self.key], order)
        touched = sorted(r[0] for r in self.staged(stage).select(part.alias("p")).distinct().collect())  # one of each part at most
        folders = self.state(stage.base)[1] if stage.base else {}
        held = [f"{self.path}/{folders[p]}" for p in touched if p in folders]
        old = self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)
        out = old.join(new.select(self.key), self.key, "left_anti").select(*new.columns).unionByName(new) if combine is None else combine(old, new)
        folder = f"parts/{stage.folder.split('/')[-1]}"
        out.withColumn("_part", part).repartition("_part").write.mode("overwrite").partitionBy("_part").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        files, _ = _path(self.spark, self.path)
        # A part that has no rows any more has no folder.
        made = [(p, f"{folder}/_part={p}" if files.exists(_path(self.spark, f"{self.path}/{folder}/_part={p}")[1]) else "") for p in touched]
        return Stage(stage.base, stage.folder, tuple(made))

    def commit(self, stage: Stage) -> int:
        """Makes the merged folders those of the table. ``LostCommit`` if there is a commit that the load did not begin from."""
        number, folders = self.state(stage.base) if stage.base else (0, {})
        text = json.dumps({"parts": {str(k): v for k, v in (folders | dict(stage.merged)).items() if v}, "base": stage.base})
        files, aside = _path(self.spark, f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = files.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        # The number is claimed by a file that can be made once; only its maker renames the commit to it.
        claim = _path(self.spark, f"{self.path}/claims/{number + 1}")[1]
        if self.commits()[-1:] > [number] or not files.createNewFile(claim):
            files.delete(aside, False)
            raise LostCommit(f"commit {number + 1} of {self.path} is another load's")
        if not files.rename(aside, _path(self.spark, f"{self.path}/commits/{number + 1}.json")[1]):
            raise OSError(f"cannot rename commit {number + 1} of {self.path}")
        return number + 1

    def release(self, number: int) -> None:
        """Gives up a claim whose maker died before its commit was there, so that others can commit."""
        if number not in self.commits():
            files, claim = _path(self.spark, f"{self.path}/claims/{number}")
            files.delete(claim, False)

    def load(self, rows: DataFrame, order: Column, checks: Mapping[str, Column] | None = None, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, tries: int = 3) -> int:
        """Stages, validates, merges and commits; merged anew, from the commit that came between, when another load was first."""
        stage = self.stage(rows)
        self.validate(stage, checks or {})
        for n in range(tries):
            try:
                return self.commit(self.merge(stage, order, combine))
            except LostCommit:
                if n + 1 == tries:
                    raise
                stage = Stage(self.state()[0], stage.folder)
        raise ValueError("tries is at least 1")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes commits but the last ``keep``, and folders that no commit left names; returns how many folders went."""
        files, _ = _path(self.spark, self.path)
        numbers = self.commits()
        for n in numbers[:-keep]:
            files.delete(_path(self.spark, f"{self.path}/commits/{n}.json")[1], False)
        used = {f.split("/_part")[0] for n in numbers[-keep:] for f in self.state(n)[1].values()}
        gone = 0
        for kind in ("parts", "staged"):
            for status in files.globStatus(_path(self.spark, f"{self.path}/{kind}/*")[1]) or []:
                if f"{kind}/{status.getPath().getName()}" not in used:
                    files.delete(status.getPath(), True)
                    gone += 1
        return gone
