"""Shared helpers of the training-data operators.

Staged tables go to the folder that ``spark.checkpoint.dir`` names, which all
executors share; where the session names none (tests) a temporary one is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.staging import shared_dir

#: A word: a run of characters other than ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs only the tasks that read from it. The folder goes
    when the session ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def discard(df: DataFrame) -> None:
    """Deletes the folder of a ``staged`` table that nothing reads any more."""
    fs, at = _file_system(df.sparkSession, df._staged_at)
    fs.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> "F.Column":
    """crc32 of the column's text, modulo ``modulus`` (null ids: fold of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{name}_"
    return name


def splitter(kept: str):
    """A function that cuts a text into its words as UTF-8 bytes: runs of the ASCII characters
    ``kept`` and of all non-ASCII ones. It makes two passes over bytes and none over words."""
    table = bytes(b if b > 127 or chr(b) in kept else 32 for b in range(256))
    return lambda text: text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


class Numbered(dict):
    """Word -> small integer, given out in order of first sight; ``words`` is the inverse.

    ``forget`` bounds the memory: past ``most`` distinct words the table starts anew,
    and arrays that callers keep per number must be dropped with it.
    """

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.words: list = []
        self.most = most

    def __missing__(self, word):
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def full(self) -> bool:
        return len(self.words) > self.most

    def forget(self) -> None:
        self.clear()
        self.words.clear()


def slices(texts: list, budget: int = 2_000_000):
    """(from, to) runs of ``texts`` with about ``budget`` characters, one text at least."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if k > start and held + n > budget:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
