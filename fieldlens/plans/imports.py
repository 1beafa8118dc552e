"""Routing and loading of standard imports (I3): every row of a resource is applied or gets its first failed rule.

The reference refuses a whole file at its first bad row, with the database's word on dates, enumerations and parents.
Here one pass gives each row its outcome: text rules first (required, number), then dates and months, enumerations,
e-mails and ranges, then missing parents by one left join a reference. What passes is merged by the resource's mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.quality import CUSTOMER_TYPES, EMAIL_SHAPE
from fieldlens.plans.ingest import RESOURCE_SOURCES, apply_resource, resource_raw, typed_resource
from fieldlens.schema import RESOURCES, TENDER_STATUSES, ResourceSpec

DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
MONTH_SHAPE = r"^\d{4}-(0[1-9]|1[0-2])$"

#: Dates (ISO, of the calendar), and the values that a column may take.
DATES = {"prescriptions": "report_date", "dailyReports": "report_date", "tenders": "due_date"}
ENUMS = {("customers", "customer_type"): CUSTOMER_TYPES, ("tenders", "status"): TENDER_STATUSES}
#: Smallest value of each number, and the numbers that are whole.
LEAST = {("prescriptions", "quantity"): 1}
WHOLE = {("prescriptions", "quantity"), ("tenders", "quantity"), ("kpiTargets", "target_prescriptions")}
#: Parent table of each reference; its key has the same name.
PARENTS = {"territory_id": "territory", "employee_id": "employee", "customer_id": "customer", "product_id": "product"}


def value_rules(spec: ResourceSpec) -> list[tuple[Column, str]]:
    """(violated, reason) of the rules on a row's own values, in the order in which they are tried."""
    rules = []
    names = spec.column_names()
    if spec.name in DATES:
        d = F.col(DATES[spec.name])
        bad = d.isNotNull() & ~(d.rlike(DATE_SHAPE) & d.try_cast("date").isNotNull())
        rules.append((bad, f"{DATES[spec.name]} is not a date"))
    if "period" in names:
        rules.append((~F.col("period").rlike(MONTH_SHAPE), "period is not a month"))
    for (resource, column), allowed in ENUMS.items():
        if resource == spec.name:
            rules.append((~F.col(column).isin(*allowed), f"{column} is not allowed"))
    if "email" in names:
        rules.append((~F.col("email").rlike(EMAIL_SHAPE), "email is not valid"))
    for f in spec.fields:
        if f.kind == "number":
            v, place = F.col(f.name), (spec.name, f.name)
            bad = v < LEAST.get(place, 0)
            if place in WHOLE:
                bad = bad | (v != F.floor(v)) | (v > 2**31 - 1)
            rules.append((bad, f"{f.name} is out of range"))
    return rules


def references(spec: ResourceSpec) -> list[str]:
    """The columns that name a parent: not a resource's own key."""
    return [c for c in spec.column_names() if c in PARENTS and spec.keys != (c,)]


def route_resource(raw: DataFrame, spec: ResourceSpec, T, target: DataFrame) -> DataFrame:
    """Every row of ``raw``, typed, with ``error`` (its first failed rule, or NULL) and ``outcome``.

    ``outcome`` is judged against the stored ``target``: rejected, or by the resource's mode appended, updated (the key
    is stored), kept (stored, and the mode only inserts) or inserted. An optional reference may be NULL.
    """
    df = typed_resource(raw, spec)
    tests = [F.get("_errors", F.lit(0))]
    tests += [F.when(bad, F.lit(reason)) for bad, reason in value_rules(spec)]
    for c in references(spec):
        parent = getattr(T, PARENTS[c]).select(F.col(c).cast("string").alias(f"_parent_{c}")).distinct()
        df = df.join(parent, F.col(c) == F.col(f"_parent_{c}"), "left")
        tests.append(F.when(F.col(c).isNotNull() & F.col(f"_parent_{c}").isNull(), F.lit(f"unknown {c}")))
    df = df.withColumn("error", F.coalesce(*tests)).drop("_errors", *[f"_parent_{c}" for c in references(spec)])
    if spec.mode == "append":
        passed = F.lit("appended")
    else:
        stored = target.select(*[F.col(k).cast("string").alias(f"_key_{k}") for k in spec.keys],
                               F.lit(True).alias("_stored")).distinct()
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in spec.keys])
        df = df.join(stored, same, "left").drop(*[f"_key_{k}" for k in spec.keys])
        known = "kept" if spec.mode == "insert_absent" else "updated"
        passed = F.when(F.col("_stored"), F.lit(known)).otherwise(F.lit("inserted"))
    return df.withColumn("outcome", F.when(F.col("error").isNotNull(), F.lit("rejected")).otherwise(passed)).drop("_stored")


def load_resource(raw: DataFrame, spec: ResourceSpec, T, target: DataFrame, seq: str = "source_row"):
    """I3 applied: (``target`` with the rows that pass merged in, the rejected rows with their ``error``).

    Of several rows with one key the last by ``seq`` wins.
    """
    routed = route_resource(raw, spec, T, target)
    types = {f.name: f.dataType for f in target.schema.fields}
    passed = routed.filter(F.col("error").isNull())
    good = passed.select(seq, *[F.col(c).try_cast(types[c]).alias(c) for c in spec.column_names() if c in types])
    return apply_resource(target, good, spec, seq), routed.filter(F.col("error").isNotNull()).drop("outcome")


def stored_table(T, resource: str) -> DataFrame:
    return getattr(T, RESOURCE_SOURCES[resource][0])


def routed(T, resource: str) -> DataFrame:
    """``route_resource`` of the damaged input of a resource."""
    return route_resource(resource_raw(T, resource, damaged=True), RESOURCES[resource], T, stored_table(T, resource))


def import_outcomes(T) -> DataFrame:
    """Rows by resource, outcome and error, over all eleven resources."""
    parts = [routed(T, r).groupBy("outcome", "error").agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(r).alias("resource"), "outcome", "error", "rows") for r in RESOURCES]
    return reduce(DataFrame.unionByName, parts)
