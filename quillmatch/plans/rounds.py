"""Where the rounds of a resolution are kept, so that a run that was lost goes on after its last one.

Under a folder that all executors share, each table of a round is a partition, `<table>/iteration=NN`,
which a rerun of the round replaces. A round's manifest, `manifest/iteration=NN`, is written last: what
it counted, the thresholds of the next round, and the parameters. A round without one is not there.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from quillmatch.plans.params import Params
from quillmatch.plans.staging import staged


class Rounds:
    """Keeps tables by round in a folder, or without one stages them for this session alone."""

    def __init__(self, spark: SparkSession, folder: str | None, p: Params):
        self.spark, self.folder, self.params = spark, folder.rstrip("/") if folder else None, asdict(p)

    def _path(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/iteration={number:02d}"

    def keep(self, df: DataFrame, name: str, number: int, **seen: Column) -> DataFrame:
        return staged(df, self._path(name, number) if self.folder else None, **seen)

    def table(self, name: str, number: int) -> DataFrame:
        return self.spark.read.parquet(self._path(name, number))

    def end(self, number: int, **facts) -> None:
        """The round is whole."""
        if self.folder:
            text = json.dumps({"number": number, "params": self.params, **facts})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self._path("manifest", number))

    def found(self) -> list[dict]:
        """The manifests of rounds 1, 2, ... that were kept of a run with these parameters."""
        if not self.folder:
            return []
        try:
            lines = self.spark.read.text(f"{self.folder}/manifest").select("value").collect()  # one for each round
        except AnalysisException:  # none yet
            return []
        known = {m["number"]: m for m in (json.loads(r["value"]) for r in lines) if m["params"] == self.params}
        out = []
        while (number := len(out) + 1) in known:
            out.append(known[number])
        return out
