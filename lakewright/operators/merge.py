"""MERGE, change capture and delete as functions from table states to a new state.

Both merges are projections of one pairing of target and source rows by key, a
full outer join in meaning. Short jobs measure both sides and choose how it runs:

* a small source is broadcast, and the target is not shuffled;
* two large sides without frequent keys are joined by one full outer join;
* with a frequent key, which AQE cannot split in a full outer join, a left join
  and an anti join take its place, where it can.

Null keys never match, as in SQL. A small source is pinned; a large one is read more than
once, so checkpoint one that is costly to compute.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

from lakewright.session import ensure_checkpoint_dir

MANY_MATCHES = "several source rows match one target row"
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
LARGE_TARGET = 5_000_000
SAMPLE_ROWS = 1_000_000
FREQUENT_SHARE = 0.005
EVEN_ROWS = 1_000_000


@dataclass(frozen=True)
class _Measured:
    small: bool
    repeats: bool
    most: int


def _bytes(rows: DataFrame, count: int) -> int:
    """About the bytes of `count` rows: eight per fixed-width field, the real length of the others."""
    fixed = 8 * len(rows.columns) * count
    lengths = []
    for field in rows.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            lengths.append(F.octet_length(field.name))
        elif not isinstance(field.dataType, AtomicType):
            lengths.append(F.octet_length(F.to_json(F.struct(field.name))))
    if not lengths:
        return fixed
    return fixed + sum(n or 0 for n in rows.agg(*[F.sum(x) for x in lengths]).first())


def _measure(rows: DataFrame, keys: Sequence[str], unique: bool) -> _Measured:
    """Size of the source, whether keys repeat, and the most rows with equal or null keys.

    The first job reads key columns only, with map-side sums; the other columns
    are measured only when there are few rows.
    """
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    if unique:
        count, nulls = rows.agg(F.count_if(keyed), F.count_if(~keyed)).first()
        repeated, most = 1, max(nulls, 1)
    else:
        per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        count, repeated, most = per_key.agg(
            *[
                F.coalesce(value, F.lit(0))
                for value in (F.sum(F.when(keyed, F.col("_rows"))), F.max(F.when(keyed, F.col("_rows"))), F.max("_rows"))
            ]
        ).first()
    small = count <= BROADCAST_ROWS and _bytes(rows, count) <= BROADCAST_BYTES
    return _Measured(small, repeated > 1, most)


def _frequent_keys(target: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys, null included, that fill more than FREQUENT_SHARE of a sample of a large target.

    At most about 1 / FREQUENT_SHARE rows. A missed key costs time, never rows.
    """
    held = target.select(*keys)
    rows = held.count()
    if rows <= LARGE_TARGET:
        return None
    ensure_checkpoint_dir(target.sparkSession)
    frequent = (
        held.sample(min(1.0, SAMPLE_ROWS / rows), seed=1)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_seen"))
        .filter(F.col("_seen") > FREQUENT_SHARE * SAMPLE_ROWS)
        .select(*keys)
        .checkpoint()
    )
    return None if frequent.isEmpty() else frequent


def _build_keys(target: DataFrame, frequent: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Keys of the target for the build side of an anti join, frequent ones once."""
    held = target.select(*keys).dropna()
    if frequent is None:
        return held
    frequent = F.broadcast(frequent)
    rare = held.join(frequent, list(keys), "left_anti")
    return rare.unionByName(held.join(frequent, list(keys), "left_semi").distinct())


def _own(name: str, *sides: DataFrame) -> str:
    """An internal column name that none of the tables has."""
    taken = {c.lower() for side in sides for c in side.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _single_match(target: DataFrame, rows: DataFrame, keys: Sequence[str], small: bool) -> Column:
    """True, or an error when a target row meets more than one source row."""
    repeated = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = repeated.filter("_rows > 1").select(*keys)
    met = target.select(*keys).join(F.broadcast(repeated) if small else repeated, list(keys), "left_semi")
    many = met.agg(F.count(F.lit(1))).scalar() > 0
    return F.when(many, F.raise_error(F.lit(MANY_MATCHES)).cast("boolean")).otherwise(F.lit(True))


def _pair(target: DataFrame, rows: DataFrame, keys: Sequence[str], unique: bool) -> tuple[DataFrame, Column, Column]:
    """Target and source rows by key with target columns; a column that is null without a
    target row, and a struct of the source row, null without one.

    A small source, and what it has that the target lacks, are pinned by checkpoints, so
    the result reads target and source once each and chained merges grow linearly.
    """
    keys = list(keys)
    measured = _measure(rows, keys, unique)
    here, new = _own("_held", target, rows), _own("_new", target, rows)
    if measured.small:
        ensure_checkpoint_dir(target.sparkSession)
        rows = rows.checkpoint()
    held = target.withColumn(here, F.lit(True))
    payload = F.struct(F.lit(True).alias(_own("_row", rows)), *[c for c in rows.columns if c not in keys])
    incoming = rows.select(*keys, payload.alias(new))
    checked = _single_match(target, rows, keys, measured.small) if measured.repeats else None

    if measured.small:
        keyed = F.broadcast(incoming.dropna(subset=keys))
        # Keys on both sides: no more than the source has.
        on_both = target.select(*keys).join(F.broadcast(rows.select(*keys).dropna()), keys, "left_semi").distinct()
        matched = F.broadcast(on_both)
    else:
        frequent = _frequent_keys(target, keys)
        if frequent is None and measured.most <= EVEN_ROWS:
            pairs = held.join(incoming, keys, "full")
            return pairs if checked is None else pairs.filter(checked), F.col(here), F.col(new)
        keyed = incoming.dropna(subset=keys)
        matched = _build_keys(target, frequent, keys)

    found = held.join(keyed, keys, "left")
    if checked is not None:
        found = found.filter(checked)
    alone = incoming.join(matched, keys, "left_anti")
    if measured.small:
        alone = alone.checkpoint()
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema.fields if f.name not in keys]
    return found.unionByName(alone.select(*keys, *absent, new)), F.col(here), F.col(new)


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    set_cols: Sequence[str] | None = None,
    unique_source: bool = False,
) -> DataFrame:
    """Target after `WHEN MATCHED UPDATE SET set_cols / WHEN NOT MATCHED INSERT *`.

    `set_cols` defaults to every non-key column. Source columns are matched by
    name and cast to the target's types; other columns are ignored. Merging the
    same source again changes nothing unless it has null keys, which are inserted
    every time. `unique_source` promises one row per key and saves a shuffle.
    """
    set_cols = [c for c in target.columns if c not in keys] if set_cols is None else list(set_cols)
    rows = source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])
    pairs, held, new = _pair(target, rows, keys, unique_source)
    inserted, matched_or_inserted = held.isNull(), new.isNotNull()

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        taken = matched_or_inserted if name in set_cols else inserted
        return F.when(taken, new[name]).otherwise(F.col(name)).alias(name)

    return pairs.select(*[value(c) for c in target.columns])


def merge_cdc(
    target: DataFrame,
    outbox: DataFrame,
    keys: Sequence[str],
    op: str = "op",
    unique_source: bool = False,
) -> DataFrame:
    """Target after applying an outbox of D(elete), U(pdate) and I(nsert) rows.

    D and U act only on keys that exist, I only on keys that do not; every other
    combination, and a null op, changes nothing.
    """
    rows = outbox.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields],
        F.col(op).alias(change := _own("_op", target)),
    )
    pairs, held, new = _pair(target, rows, keys, unique_source)
    inserted, action = held.isNull(), new[change]
    kept = F.when(inserted, action.eqNullSafe("I")).otherwise(~action.eqNullSafe("D"))
    taken = inserted | action.eqNullSafe("U")
    return (
        pairs.filter(kept)
        .select(
            *[
                F.col(c) if c in keys else F.when(taken, new[c]).otherwise(F.col(c)).alias(c)
                for c in target.columns
            ]
        )
    )


def latest_change(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by `order`, taken by an aggregate rather than a sorted window."""
    row = F.struct(*[c for c in changes.columns if c not in keys])
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(row, F.struct(*order)).alias("_last"))
        .select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in changes.columns])
    )


def collapse_changes(outbox: DataFrame, keys: Sequence[str], op: str, order: Sequence[str]) -> DataFrame:
    """Several changes per key reduced to the one with the same net effect.

    Last op D gives D. Otherwise the key ends up present with the last values: as
    I if the first change created it, as U if it existed before. Rows with another
    op do nothing and are left out.
    """
    valid = outbox.filter(F.col(op).isin("I", "U", "D"))
    row = F.struct(*[c for c in outbox.columns if c not in keys])
    at = F.struct(*order)
    last = F.col("_last")
    net = F.when(last[op] == "D", "D").when(F.col("_first") == "I", "I").otherwise("U")
    return (
        valid.groupBy(*keys)
        .agg(F.min_by(op, at).alias("_first"), F.max_by(row, at).alias("_last"))
        .select(
            *[
                F.col(c) if c in keys else (net if c == op else last[c]).alias(c)
                for c in outbox.columns
            ]
        )
    )


def delete_where(target: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which `predicate` is not true; null keeps the row, as in SQL DELETE."""
    return target.filter(~F.coalesce(predicate, F.lit(False)))


def live_rows(df: DataFrame, flag_col: str = "is_deleted") -> DataFrame:
    """Rows that are not soft-deleted."""
    return delete_where(df, F.col(flag_col).cast("boolean"))


def change_summary(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts (change, row_count) by inserted, updated, deleted and unchanged.

    Equal rows are counted together first, per side, so repeated rows shrink
    before the shuffle and no join is needed. Per key, what only one side has is
    paired off as updates; the rest is deleted or inserted.
    """
    cols = before.columns
    sides = before.select(*cols, F.lit(1).alias("_old")).unionByName(
        after.select(*cols, F.lit(0).alias("_old"))
    )
    old = F.sum(F.col("_old").cast("long"))
    per_row = sides.groupBy(*cols).agg(old.alias("_before"), (F.count(F.lit(1)) - old).alias("_after"))
    common = F.least("_before", "_after")
    per_key = per_row.groupBy(*keys).agg(
        F.sum(common).alias("_same"),
        F.sum(F.col("_before") - common).alias("_gone"),
        F.sum(F.col("_after") - common).alias("_new"),
    )
    paired = F.least("_gone", "_new")
    totals = per_key.agg(
        F.coalesce(F.sum(F.col("_new") - paired), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(paired), F.lit(0)).alias("updated"),
        F.coalesce(F.sum(F.col("_gone") - paired), F.lit(0)).alias("deleted"),
        F.coalesce(F.sum("_same"), F.lit(0)).alias("unchanged"),
    )
    return totals.unpivot([], ["inserted", "updated", "deleted", "unchanged"], "change", "row_count")
