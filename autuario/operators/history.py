"""History of changing attributes: validity periods from consecutive snapshots.

Every change is found by a null-safe full outer join of a snapshot with the one
before it: a key on the later side only was inserted, on the earlier side only
deleted, on both with another content changed. The events of all snapshots together,
in order, are the history; an event that isn't a deletion opens a period, and the
next event of its key, a deletion too, closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autuario.operators.ordering import BLOCK, POSITION, lead_within, ordered
from autuario.runtime import cut

EVENTS = ("inserted", "changed", "deleted")


def _change(is_now: Column, was: Column, same: Column) -> Column:
    """What a pair of states, of which one may be missing, means."""
    return F.when(is_now & ~was, "inserted").when(was & ~is_now, "deleted").when(is_now & was & ~same, "changed").otherwise("unchanged")


def snapshot_events(entries: DataFrame, steps: DataFrame) -> DataFrame:
    """``step, entity_id, content, valid_from, change``: the changes between consecutive full snapshots.

    ``entries``: ``snapshot, entity_id, content``. ``steps``: ``step, prev, next, at``: the
    snapshots to compare and the instant of the later one; a first snapshot has a null
    ``prev``. A snapshot is at most once ``prev`` and once ``next``; the steps are the
    snapshots' list, with one row each.

    The join's key is (step, entity), which is unique on either side once repeats are
    gone, so neither a large snapshot nor an entity in all snapshots fills a task.
    Rows with a null snapshot or entity don't count; of several contents of an entity in
    a snapshot the least counts, null before all; a snapshot without entries is empty.
    """
    single = cut(entries.where("snapshot is not null and entity_id is not null").groupBy("snapshot", "entity_id").agg(F.min(F.struct(F.col("content").isNotNull(), "content"))["content"].alias("content")), "history-entries")
    now = steps.select("step", F.col("next").alias("snapshot")).join(single, "snapshot").select("step", "entity_id", "content", F.lit(True).alias("is"))
    then = steps.where("prev is not null").select("step", F.col("prev").alias("snapshot")).join(single, "snapshot").select(
        F.col("step").alias("step_"), F.col("entity_id").alias("entity_"), F.col("content").alias("content_"), F.lit(True).alias("was"))
    both = now.join(then, F.col("step").eqNullSafe(F.col("step_")) & F.col("entity_id").eqNullSafe(F.col("entity_")), "full_outer")
    there = lambda c: F.coalesce(c, F.lit(False))
    events = both.select(
        F.coalesce("step", "step_").alias("step"), F.coalesce("entity_id", "entity_").alias("entity_id"), F.when(F.col("is"), F.col("content")).otherwise(F.col("content_")).alias("content"),
        _change(there(F.col("is")), there(F.col("was")), F.col("content").eqNullSafe(F.col("content_"))).alias("change"),
    ).where(F.col("change").isin(*EVENTS))
    return events.join(steps.select("step", F.col("at").alias("valid_from")), "step").select("step", "entity_id", "content", "valid_from", "change")


def snapshot_history(entries: DataFrame, steps: DataFrame, group: str) -> DataFrame:
    """``group, entity_id, content, valid_from, valid_to, change``: periods of validity from full snapshots.

    As ``snapshot_events``; ``steps`` has one more column, whose name is ``group``: the series a
    snapshot belongs to, in which an entity has its own history. A period ends when the
    entity changes or is gone.
    """
    events = snapshot_events(entries, steps).join(steps.select("step", F.col(group).alias("_group")), "step")
    keyed = events.withColumn("key", F.struct("_group", "entity_id")).select("key", "content", "valid_from", "change")
    return _periods(ordered(keyed, ["key", "valid_from"], "history-events")).select(F.col("key._group").alias(group), F.col("key.entity_id").alias("entity_id"), "content", "valid_from", "valid_to", "change")


def _periods(events: DataFrame) -> DataFrame:
    """Events in order with ``valid_to``: the instant of the key's next event; deletions only close."""
    return lead_within(events, "key", "valid_from", "valid_to").where("change <> 'deleted'")


def history(df: DataFrame, entity: str | list[str], content: str, instant: str, deletions: DataFrame | None = None) -> DataFrame:
    """Validity periods of each entity's contents, from a log of contents as they were seen.

    Result: ``entity_id, content, valid_from, valid_to, change`` where ``change`` is
    ``inserted`` for an entity's first period, also after a deletion, and ``changed`` for each
    other one; ``valid_to`` is the instant of the entity's next change or deletion, null for
    the current period. ``entity`` may be several columns; ``entity_id`` then is a struct.

    The log is taken as snapshots of each entity: row k of an entity in order of instant is
    its state in snapshot k, which is joined with snapshot k-1 by a null-safe full outer
    join. ``deletions`` (the columns of ``entity`` and ``instant``) are states in which the
    entity isn't there; other ends of an entity's log are no deletions, as a log holds
    only what was seen. States are addressed by their position in the global order, so an
    entity with a third of all rows is spread over all tasks.

    Cases: rows with a null entity or instant don't count; a null content is a
    content of its own; rows delivered twice start no period; rows of one instant
    with different contents follow each other in order of content, a deletion before
    them; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    names = [entity] if isinstance(entity, str) else entity
    key = F.col(f"`{names[0]}`") if isinstance(entity, str) else F.struct(*[F.col(f"`{n}`") for n in names])
    known = F.col(f"`{instant}`").isNotNull()
    for n in names:
        known = known & F.col(f"`{n}`").isNotNull()
    log = df.where(known).select(key.alias("key"), F.lit(True).alias("there"), F.col(f"`{content}`").alias("content"), F.col(f"`{instant}`").alias("valid_from"))
    if deletions is not None:
        gone = deletions.where(known).select(key.alias("key"), F.lit(False).alias("there"), F.lit(None).alias("content"), F.col(f"`{instant}`").alias("valid_from"))
        log = log.unionByName(gone)
    now = ordered(log, ["key", "valid_from", "there", "content"], "history")
    then = now.select((F.col(POSITION) + 1).alias("_before"), F.col("key").alias("_key"), F.col("content").alias("_content"), F.col("there").alias("_was"))
    both = now.join(then, (F.col(POSITION) == F.col("_before")) & F.col("key").eqNullSafe(F.col("_key")), "full_outer")
    is_now, was = F.coalesce("there", F.col("_was")), F.coalesce("_was", F.lit(False))  # past its last row an entity stays as it was
    changed = both.withColumn("change", _change(is_now, was, F.col(POSITION).isNull() | F.col("content").eqNullSafe(F.col("_content"))))
    events = cut(changed.where(F.col("change").isin(*EVENTS)).select(BLOCK, POSITION, "key", "content", "valid_from", "change"), "history-events")
    return _periods(events).select(F.col("key").alias("entity_id"), "content", "valid_from", "valid_to", "change")
