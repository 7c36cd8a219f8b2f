"""Constrained loads: static rules, conflicts, missing parents, and what happened to each row.

A row offered to the masked side is inserted, in conflict (its id is there already, or an earlier
row of the load brought it) or skipped with a reason. The order of the checks is the order a
database applies them: value errors, NULLs and range rules, then the id, then the parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.registry import ENUMS, Entity, children_of, entity as lookup
from veilframe.session import materialize

MISSING_PARENT = "parent row missing (FK)"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _quoted(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f'{prefix}: "'), value, F.lit('"'))


def _value_error(field, raw: Column, typed: Column) -> Column | None:
    """Why a present value does not fit its column, or NULL. The wording is the database's own."""
    text = raw.cast("string")
    bad = raw.isNotNull() & typed.isNull()
    syntax = _quoted(f"invalid input syntax for type {field.sql_type}", text)
    if isinstance(field.dtype, (T.LongType, T.ShortType)):
        out_of_range = F.concat(
            F.lit('value "'), text, F.lit(f'" is out of range for type {field.sql_type}')
        )
        return F.when(bad, F.when(text.rlike(INTEGER), out_of_range).otherwise(syntax))
    if isinstance(field.dtype, T.DecimalType):
        return F.when(bad, F.when(text.rlike(DECIMAL), F.lit("numeric field overflow")).otherwise(syntax))
    if isinstance(field.dtype, (T.DateType, T.TimestampType)):
        return F.when(bad, syntax)
    if field.enum:
        wrong = ~F.coalesce(text.isin(*ENUMS[field.enum]), F.lit(True))
        return F.when(wrong, _quoted(f"invalid input value for enum {field.enum}", text))
    if field.char:
        too_long = F.length(F.rtrim(text)) > field.char
        return F.when(too_long, F.lit(f"value too long for type character({field.char})"))
    return None


def constraint_report(rows: DataFrame, entity: str) -> DataFrame:
    """Cast to the declared types and add ``reason``, the first rule a row breaks on its own.

    Columns the entity does not declare (arrival number, reply id) are kept.
    """
    ent = lookup(entity)
    declared = set(ent.columns)
    typed, value_errors, nulls, checks = {}, [], [], []
    for f in ent.fields:
        raw = F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dtype)
        value = raw.try_cast(f.dtype)
        typed[f.name] = value
        error = _value_error(f, raw, value)
        if error is not None:
            value_errors.append(error)
        if not f.nullable:
            message = f'null value in column "{f.name}" of relation "{entity}" violates not-null constraint'
            nulls.append(F.when(raw.isNull(), F.lit(message)))
        if f.between:
            message = f'new row for relation "{entity}" violates check constraint "{entity}_{f.name}_check"'
            checks.append(F.when(~value.between(*f.between), F.lit(message)))
    rest = [F.col(c) for c in rows.columns if c not in declared]
    return rows.select(
        *rest,
        *[typed[c].alias(c) for c in ent.columns],
        F.coalesce(*value_errors, *nulls, *checks).alias("reason"),
    )


def missing_ids(raw: DataFrame, masked: DataFrame) -> DataFrame:
    """Ids the masked side lacks, gaps below its highest id included. Narrow on both sides."""
    return raw.select("id").join(masked.select("id"), "id", "left_anti")


def missing_parents(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Distinct parent keys of ``rows`` that no parent has.

    The children are reduced to distinct keys before the shuffle, so a parent that owns a third of
    all children is one row per task here. The result is written: it is small or empty in a sound
    load, and with its size known the planner probes it in place instead of shuffling the children.
    """
    wanted = rows.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()
    return materialize(wanted.join(parents.select("id"), "id", "left_anti"), "missing-parents")


def fk_violations(rows: DataFrame, parents: DataFrame, entity: str) -> DataFrame:
    """Rows whose parent is absent, with the reason."""
    ent = lookup(entity)
    lost = missing_parents(rows, parents, ent.parent_key).withColumnRenamed("id", ent.parent_key)
    found = rows.join(lost, ent.parent_key, "left_semi").select(*rows.columns)
    return found.withColumn("reason", F.lit(MISSING_PARENT))


def classify_load(
    incoming: DataFrame,
    existing: DataFrame,
    entity: str,
    order: str,
    parents: DataFrame | None = None,
) -> DataFrame:
    """Decide every incoming row: typed columns plus ``outcome`` and ``reason``.

    ``order`` is a unique arrival number.
    """
    report = materialize(constraint_report(incoming, entity), "load-report")  # read by each of the steps
    return decide_load(report, existing, entity, order, parents)


def decide_load(
    report: DataFrame,
    existing: DataFrame,
    entity: str,
    order: str,
    parents: DataFrame | None = None,
) -> DataFrame:
    """``classify_load`` for rows with a ``constraint_report`` that several steps may read.

    Decisions per id are taken on narrow columns (id, arrival number) that are combined before the
    shuffle. Ids that are there already or come more than once are written: they are few in a sound
    load, so that the rows meet them in place and are not shuffled. Where they are many, the rows meet
    them in one join on id, where the adaptive plan splits an id that arrives very often.
    """
    ent = lookup(entity)
    kept = [c for c in report.columns if c not in {*ent.columns, "reason"}]
    if ent.parent_key is not None and parents is not None:
        lost = missing_parents(report.where(F.col("reason").isNull()), parents, ent.parent_key)
        lost = lost.select(F.col("id").alias(ent.parent_key), F.lit(True).alias("_orphan"))
        report = report.join(lost, ent.parent_key, "left")
    else:
        report = report.withColumn("_orphan", F.lit(None).cast("boolean"))

    sound = F.col("reason").isNull()
    loadable = sound & F.col("_orphan").isNull()
    per_id = (
        report.where(sound)
        .groupBy("id")
        .agg(F.min(F.when(loadable, F.col(order))).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .join(existing.select("id", F.lit(True).alias("_there")), "id", "left")
    )
    met = per_id.where(F.col("_there").isNotNull() | (F.col("_n") > 1)).drop("_n")
    decided = report.join(materialize(met, "met-ids"), "id", "left")
    status = (
        F.when(~sound, "skipped")
        .when(F.col("_there") | (F.col("_first") < F.col(order)), "conflict")
        .when(F.col("_orphan"), "skipped")
        .otherwise("inserted")
    )
    decided = decided.withColumn("outcome", status)
    reason = F.coalesce(
        F.col("reason"),
        F.when((F.col("outcome") == "skipped") & F.col("_orphan"), F.lit(MISSING_PARENT)),
    )
    return decided.withColumn("reason", reason).select(
        *kept, *ent.columns, "outcome", "reason"
    )


def insert_if_absent(incoming: DataFrame, existing: DataFrame, entity: str, order: str) -> DataFrame:
    """The rows an insert that ignores conflicts adds: first by arrival, not there yet.

    The smallest arrival number per id is found on two narrow columns, combined before the shuffle.
    """
    first = incoming.groupBy("id").agg(F.min(order).alias(order))
    fresh = first.join(existing.select("id"), "id", "left_anti")
    # joined on id alone, on which the smallest numbers were found and are still dealt out
    met = incoming.join(fresh.select("id", F.col(order).alias("_first")), "id")
    return met.where(F.col(order) == F.col("_first")).select(*lookup(entity).columns)


def accepted(decided: DataFrame, entity: str) -> DataFrame:
    return decided.where(F.col("outcome") == "inserted").select(*lookup(entity).columns)


def upsert(old: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """Insert or replace by id: the new snapshot.

    Which old rows survive is decided on ids alone and written first. In a mirror few or none do, so
    the planner, knowing the size, fetches them without shuffling the old rows.
    """
    columns = lookup(entity).columns
    stale = materialize(missing_ids(old, new), "stale-ids")
    survivors = old.join(stale, "id", "left_semi")
    return new.select(*columns).unionByName(survivors.select(*columns))


def cascade_delete(tables: dict[str, DataFrame], entity: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete rows by id and everything below them; returns what is left of each table."""
    left = dict(tables)
    _delete(left, tables, lookup(entity), ids.select("id").distinct())
    return left


def _delete(left: dict[str, DataFrame], tables: dict[str, DataFrame], ent: Entity, gone: DataFrame) -> None:
    left[ent.name] = left[ent.name].join(gone, "id", "left_anti").select(*ent.columns)
    for child in children_of(ent.name):
        if child.name in tables:
            parent = gone.select(F.col("id").alias(child.parent_key))
            orphans = tables[child.name].select("id", child.parent_key)
            _delete(left, tables, child, orphans.join(parent, child.parent_key, "left_semi").select("id"))


def load_summary(decided: DataFrame, *by: str) -> DataFrame:
    """Rows received, inserted, in conflict and skipped, with the reason of the last skip.

    Counts are combined before the shuffle; so is the reason, of which ``by`` groups keep the one
    with the greatest text when several occur.
    """
    def n(status: str) -> Column:
        return F.count_if(F.col("outcome") == status)

    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"),
        n("inserted").alias("inserted"),
        n("conflict").alias("conflicts"),
        n("skipped").alias("skipped"),
        F.max("reason").alias("reason"),
    )
