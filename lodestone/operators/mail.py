"""Mail tables: entries, counts, cursors and incremental synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(messages: DataFrame, untitled: str = "(no subject)") -> DataFrame:
    """Mails as catalog entries: the subject is the name."""
    name = F.coalesce(F.when(F.col("subject") != "", F.col("subject")), F.lit(untitled))
    return messages.select(name.alias("name"), "path", F.lit("mail").alias("kind"), F.lit("mail").alias("extension"), "account", "folder", "sender", F.substring("sent_at", 1, 10).alias("date"))


def folder_counts(messages: DataFrame) -> DataFrame:
    """Mails of each folder, inbox first, then the fullest."""
    inbox = F.lower("folder") == "inbox"
    return messages.groupBy("account", "folder").agg(F.count("*").alias("n")).orderBy(inbox.desc(), F.col("n").desc(), "account", "folder")


def cursors(messages: DataFrame) -> DataFrame:
    return messages.groupBy("account", "folder").agg(F.max("uid").alias("last_uid"))


def to_fetch(source: DataFrame, stored: DataFrame, cursor: DataFrame) -> DataFrame:
    """Mails of the server ``(account, folder, uid_validity, uid, …)`` above the cursor and not stored, newest first.

    A folder whose validity changed starts again at 0, and what is stored of it doesn't count.
    """
    c = cursor.select("account", "folder", F.col("uid_validity").alias("v"), F.col("last_uid").alias("at"))
    joined = source.join(c, ["account", "folder"], "left").withColumn("fresh", F.coalesce(F.col("v") != F.col("uid_validity"), F.lit(False)))
    above = joined.filter(F.col("fresh") | (F.col("uid") > F.coalesce("at", F.lit(0))))
    known = stored.join(purged_folders(source, cursor), ["account", "folder"], "left_anti").select("account", "folder", "uid")
    return above.join(known, ["account", "folder", "uid"], "left_anti").select(*source.columns).orderBy("account", "folder", F.col("uid").desc())


def purged_folders(source: DataFrame, cursor: DataFrame) -> DataFrame:
    """Folders whose validity is another than the cursor's."""
    now = source.select("account", "folder", "uid_validity").distinct()
    c = cursor.select("account", "folder", F.col("uid_validity").alias("v"))
    return now.join(c, ["account", "folder"]).filter("v <> uid_validity").select("account", "folder")


def synced(stored: DataFrame, source: DataFrame, cursor: DataFrame) -> DataFrame:
    """The stored mails after a sync: purged folders go, fetched mails come."""
    kept = stored.join(purged_folders(source, cursor), ["account", "folder"], "left_anti")
    return kept.select(*stored.columns).unionByName(to_fetch(source, stored, cursor).select(*stored.columns))


def new_uidls(source: DataFrame, stored: DataFrame) -> DataFrame:
    """For servers without cursors: ids that are not stored."""
    return source.join(stored.select("account", "uid"), ["account", "uid"], "left_anti")


def without_account(messages: DataFrame, account: str) -> DataFrame:
    return messages.filter(F.col("account") != account)


def recipients(to: Column, cc: Column) -> Column:
    return F.concat_ws(", ", F.filter(F.array(to, cc), lambda x: x != ""))
