"""Token counts kept as additive rollups under signed changes.

A batch of changes (insert, delete, revise) becomes sums of signed counts by
source, language and tokenizer version; a rollup is the sum of its batches.
A batch is committed once: its sums are written to a folder of their own, and
a marker named after the batch says which folder counts.  A marker is written
under another name and then renamed to its own, which fails if that is taken:
it is there as a whole or not at all.  A batch that comes again, from a retry
or a second driver, finds the marker and changes nothing; folders without a
marker don't count.

`compact` sums the batches so far into a snapshot, committed by a marker in the
same way, so that totals read one snapshot and the batches after it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import hadoop_path

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
CHANGES = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokenizer_version string, old_n_tokens long"
NOTHING = {"number": 0, "folder": None, "batches": []}


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums (SCHEMA) of changes (CHANGES; other columns are not read).

    insert adds a document and its tokens, delete takes them away, revise takes the old count away under its old version and adds
    the new one. A null count is 0; null keys are a group of their own; other operations are an error. Groups whose sums are all 0 stay.
    """
    new = F.struct(F.col("tokenizer_version"), F.when(F.col("op") == "delete", -1).otherwise(1).alias("sign"), F.col("n_tokens").alias("n"))
    old = F.struct(F.coalesce("old_tokenizer_version", "tokenizer_version").alias("tokenizer_version"), F.lit(-1).alias("sign"), F.col("old_n_tokens").alias("n"))
    known = F.when(F.col("op").isin("insert", "delete"), F.array(new)).when(F.col("op") == "revise", F.array(new, old))
    signed = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))))
    rows = changes.select("source", "lang", F.explode(signed).alias("c"))
    n = F.coalesce(F.col("c.n"), F.lit(0)).cast("long")
    return rows.groupBy("source", "lang", F.col("c.tokenizer_version").alias("tokenizer_version")).agg(
        F.sum(F.col("c.sign").cast("long")).alias("n_docs"),
        F.sum(F.col("c.sign") * n).alias("n_tokens"),
    )


class TokenRollup:
    """A rollup in a folder that all drivers and executors reach, in a store whose renames are atomic."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, _ = hadoop_path(spark, self.path)

    def _path(self, name: str):
        return hadoop_path(self.spark, f"{self.path}/{name}")[1]

    def _names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        found = (s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if s.getLen())
        return [x.removesuffix(".json") for x in found if x.endswith(".json") and not x.startswith((".", "_"))]

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _there(self, name: str) -> bool:
        """Whether a marker is there. An empty one, of a writer that knew no renames and died, is taken away."""
        path = self._path(name)
        if not self.fs.exists(path):
            return False
        if not self.fs.getFileStatus(path).getLen():
            self.fs.delete(path, False)
            return False
        return True

    def _mark(self, name: str, told: dict) -> bool:
        """Writes a marker whole; False if one of that name is there."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # without the option OVERWRITE, a rename onto a file fails
            files.rename(draft, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            self.fs.delete(draft, False)
            if self.fs.exists(target):
                return False
            raise
        return True

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False, and nothing changes, if it was committed before."""
        if not re.fullmatch(r"\w[\w.-]*", batch):
            raise ValueError(f"a batch is named by letters, digits, points and dashes, not {batch!r}")
        marker = f"commits/{batch}.json"
        if self._there(marker):
            return False
        folder = f"deltas/{batch}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{folder}")
        if self._mark(marker, {"batch": batch, "folder": folder}):
            return True
        self.fs.delete(self._path(folder), True)
        return False

    def snapshot(self) -> dict:
        """number, folder and batches of the last snapshot."""
        numbers = [int(x) for x in self._names("snapshots")]
        return self._read(f"snapshots/{max(numbers)}.json") if numbers else NOTHING

    def committed(self) -> list[str]:
        """The names of all committed batches."""
        return sorted(self._names("commits"))

    def _sums(self, base: dict, batches: list[str]) -> DataFrame:
        folders = [self._read(f"commits/{b}.json")["folder"] for b in batches] + [base["folder"]] * bool(base["folder"])
        parts = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{x}" for x in folders]) if folders else self.spark.createDataFrame([], SCHEMA)
        return parts.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS])

    def _pending(self, base: dict) -> list[str]:
        return sorted(set(self.committed()) - set(base["batches"]))

    def totals(self) -> DataFrame:
        """The sums (SCHEMA) of all committed batches, without groups that have nothing left. Reads the last snapshot and the batches after it."""
        base = self.snapshot()
        return self._sums(base, self._pending(base)).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Sums everything committed so far into a new snapshot; False if there is nothing new, or another writer was first.

        Sums of batches that the snapshot before already held, and that snapshot's elder, are removed: whoever read totals before the last two
        compactions has to read them anew.
        """
        base = self.snapshot()
        if not (batches := self._pending(base)):
            return False
        folder = f"sums/{uuid.uuid4().hex}"
        self._sums(base, batches).write.parquet(f"{self.path}/{folder}")
        if not self._mark(f"snapshots/{base['number'] + 1}.json", {"number": base["number"] + 1, "folder": folder, "batches": sorted({*base["batches"], *batches}), "new": batches, "before": base["folder"]}):
            self.fs.delete(self._path(folder), True)
            return False
        for old in base.get("new", []):
            self.fs.delete(self._path(self._read(f"commits/{old}.json")["folder"]), True)
        if base.get("before"):
            self.fs.delete(self._path(base["before"]), True)
        return True
