"""Sessions of an assistant in an append-only Parquet log: save, load, list and delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

SESSIONS = "session string, number long, saved_at timestamp, deleted boolean, config string, schema_hash string, history array<struct<role:string,content:string>>"


class Sessions:
    """Each save is a row of a new file, and a delete is a row that says so; the newest row of a session counts.

    A save that fails leaves no row. Saves of one session at the same moment are not ordered.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, folder.rstrip("/") + "/log"

    def _log(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SESSIONS)
        return self.spark.read.schema(SESSIONS).parquet(self.path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        newest = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("number")))
        return rows.withColumn("_r", newest).where("_r = 1 and not deleted").drop("_r")

    def _add(self, session: str, at: str | None, deleted: bool, config: str | None, schema_hash: str | None, history: list[tuple[str, str]]) -> None:
        number = self._log().where(F.col("session") == session).agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        row = self.spark.createDataFrame([(session, number, deleted, config, schema_hash, history)], "session string, number long, deleted boolean, config string, schema_hash string, history array<struct<role:string,content:string>>")
        stamped = row.withColumn("saved_at", F.lit(at).cast("timestamp") if at else F.current_timestamp())
        stamped.select("session", "number", "saved_at", "deleted", "config", "schema_hash", "history").coalesce(1).write.mode("append").parquet(self.path)

    def save(self, session: str, history: list[tuple[str, str]], *, config: str = "{}", schema_hash: str = "", at: str | None = None) -> None:
        """Keep a session's messages (role, content) and its settings, in place of what it had."""
        self._add(session, at, False, config, schema_hash, history)

    def load(self, session: str) -> Row | None:
        """The session as it was last saved; None where there is none."""
        return self._newest(self._log().where(F.col("session") == session)).first()

    def changed_since(self, session: str, schema_hash: str) -> bool:
        """Whether the tools are other than those that the session was saved with; False where there is no session."""
        kept = self.load(session)
        return kept is not None and kept.schema_hash != schema_hash

    def list(self) -> DataFrame:
        """(session, saved_at, messages) of every session, the newest first, then by name."""
        return self._newest(self._log()).select("session", "saved_at", F.size("history").alias("messages")).orderBy(F.desc("saved_at"), "session")

    def delete(self, session: str) -> bool:
        """Take a session out; True if it was there."""
        there = self.load(session) is not None
        if there:
            self._add(session, None, True, None, None, [])
        return there
