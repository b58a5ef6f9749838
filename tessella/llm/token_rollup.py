"""Totals of token counts that batches of signed changes keep up to date.

The totals are additive: an insert adds a document's count, a delete subtracts it, a revision does
both, whatever the order of batches. So no batch looks at documents of another, and a batch is one
partially aggregated shuffle of its own rows. A batch is committed by a marker file that names its
table of sums; a batch whose marker stands is never applied again.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import exists, get_file, list_files, new_name, put_file, text_or_empty

KEYS = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens"]
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizers: dict[str, Column], source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(source, lang, version, tokens) for each row and each version; a null count is 0.

    ``tokenizers`` maps versions to columns with a row's number of tokens, such as
    ``regexp_count(text, pattern)`` or the size of an array of ids. Of the other columns only source
    and language are read; nulls there are groups of their own.
    """
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.coalesce(n, F.lit(0)).cast("long").alias("tokens")) for v, n in tokenizers.items()]))
    return docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), versions.alias("x")).select("source", "lang", "x.version", "x.tokens")


def bpe_counted(docs: DataFrame, version: str, vocabulary: str, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(source, lang, version, tokens) for each row by a byte-level vocabulary, as ``bpe.encode_documents`` has it."""
    keyed = docs.select(F.struct(F.col(source_col).alias("source"), F.col(lang_col).alias("lang")).alias("key"), F.col(text_col).alias("text"))
    encoded = encode_documents(keyed, vocabulary, id_col="key")
    return encoded.select("id.source", "id.lang", F.lit(version).alias("version"), F.size("ids").cast("long").alias("tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(1))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that take what was counted before and add what counts now; keys may differ."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """A rollup in a folder of shared storage.

    ``markers/`` has a JSON file per committed batch with the path of its sums; ``bases/`` has one
    per compaction, with the batches that it holds. Tables are written under new names first, so an
    attempt that died is never read. Two writers of one batch write equal sums and one marker wins.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _marker(self, batch: str) -> str:
        return f"{self.folder}/markers/{hashlib.sha256(batch.encode()).hexdigest()}.json"

    def committed(self) -> list[str]:
        return sorted({json.loads(get_file(p))["batch"] for p in list_files(f"{self.folder}/markers", ".json")})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply signed rows (source, lang, version, tokens, sign) once; False if the batch was applied before.

        Null signs and tokens count as 0. An empty batch is committed, too.
        """
        if exists(self._marker(batch)):
            return False
        sums = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).cast("long").alias("n_tokens"))
        path = f"{self.folder}/sums/{new_name('batch')}"
        sums.where("n_docs <> 0 OR n_tokens <> 0").write.parquet(path)
        put_file(self._marker(batch), json.dumps({"batch": batch, "path": path}).encode())
        return True

    def _parts(self) -> tuple[list[str], list[str]]:
        """(tables to add up, batches in them): the base with the most batches, and what came since."""
        bases = [json.loads(get_file(p)) for p in list_files(f"{self.folder}/bases", ".json")]
        base = max(bases, key=lambda b: (len(b["batches"]), b["path"]), default={"path": None, "batches": []})
        held = set(base["batches"])
        markers = [json.loads(get_file(p)) for p in list_files(f"{self.folder}/markers", ".json")]
        since = [m for m in markers if m["batch"] not in held]
        return [p for p in (base["path"], *(m["path"] for m in since)) if p], sorted(held | {m["batch"] for m in since})

    def _sum(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of all committed batches; what came to nothing is left out."""
        return self._sum(self._parts()[0]).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Add all committed batches up to one table. Their markers stay, so none is applied again."""
        paths, batches = self._parts()
        path = f"{self.folder}/sums/{new_name('base')}"
        self._sum(paths).write.parquet(path)
        put_file(f"{self.folder}/bases/{new_name('base')}.json", json.dumps({"batches": batches, "path": path}).encode())


def pattern_count(text: str | Column, pattern: str) -> Column:
    """The number of matches in a whole text; null counts as empty."""
    return F.regexp_count(text_or_empty(text), F.lit(pattern))
