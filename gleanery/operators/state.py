"""State of entities as it is read back: defaults for what has a wrong form, all that is open, and the newest of what is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of whole numbers, with their defaults.
COUNTS = {"done": 0, "total": 0, "last_major": None, "last_minor": None, "next_major": None, "next_minor": None}


def sound_state(raw: DataFrame, *, keep_complete: int = 50) -> DataFrame:
    """entity, name, status, the columns of COUNTS, updated_at of raw (all strings; the same columns).

    Ids are lower-cased and trimmed; rows without one go, and of rows of one id the last updated counts. A status is 'complete' or
    else 'open', a number that is none has its default, a missing name is the id. Open entities stay, and of complete ones
    the keep_complete that were updated last (null comes first; ties by id): one page of rows, whatever the table.
    """
    id_ = F.lower(F.trim("entity"))
    rows = raw.withColumn("entity", id_).filter("entity <> ''")
    number = lambda c, d: F.coalesce(F.when(F.col(c).rlike("^[+-]?[0-9]+$"), F.col(c)).try_cast("bigint"), F.lit(d).cast("bigint"))
    status = F.when(F.col("status") == "complete", "complete").otherwise("open")
    rows = rows.select("entity", F.coalesce("name", "entity").alias("name"), status.alias("status"), *(number(c, d).alias(c) for c, d in COUNTS.items()), "updated_at")
    newest = F.struct(F.coalesce("updated_at", F.lit("")), "status", "name", *COUNTS)
    rows = rows.groupBy("entity").agg(F.max_by(F.struct(*rows.columns[1:]), newest).alias("r")).select("entity", "r.*")
    complete = rows.filter("status = 'complete'").orderBy(F.desc(F.coalesce("updated_at", F.lit(""))), "entity").limit(max(0, keep_complete))
    return rows.filter("status = 'open'").unionByName(complete)


def sound_pointer(state: DataFrame, pointer: str | None) -> str | None:
    """The entity that is followed, if the pointer is one and state does not say that it is complete."""
    name = (pointer or "").lower().strip()
    if not name:
        return None
    return None if state.filter((F.col("entity") == name) & (F.col("status") == "complete")).limit(1).count() else name
