"""Company research: five answers of an API for each company, unwrapped into one row.

An answer is JSON text. The same data stands at different places in it: as the result itself or under Data within it,
as an object or a list. VARIANT paths with a declared type look at each place in turn; a place that holds another type
counts as empty. All of it is column expressions over one grouped pass.

Defined results: no answer, or one that isn't JSON, gives null; an answer with another status than 200 gives empty
lists, false and 0. Of several answers to one question the last by `moment` counts, then the larger text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.operators.relational import latest_per_key

# The questions' codes.
SEARCH, VERIFY, DISHONEST, RECRUITMENT, TENDERS = "886", "2001", "740", "718", "958"
_EMPTY = ("null", "{}", "[]", '""', "0", "false")


def part(v: Column, path: str) -> Column:
    """What stands at a path, as VARIANT; null if it is missing or empty."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(~F.to_json(found).isin(*_EMPTY), found)


def items(v: Column, path: str = "$") -> Column:
    """The list at a path; null if something else is there."""
    return F.try_variant_get(v, path, "array<variant>")


def is_object(v: Column) -> Column:
    return F.to_json(v).startswith("{")


def records(list_: Column, fields: dict[str, str]) -> Column:
    """A list of VARIANT as structs of texts: name -> path."""
    return F.transform(list_, lambda x: F.struct(*[F.try_variant_get(x, path, "string").alias(name) for name, path in fields.items()]))


HIT = {"key_no": "$.KeyNo", "name": "$.Name", "credit_code": "$.CreditCode", "status": "$.Status"}
FINDING = {"case_no": "$.Anno", "court": "$.Executegov", "date": "$.Liandate"}
JOB = {"title": "$.Title", "salary": "$.Salary", "city": "$.ProvinceDesc", "published": "$.PublishDate"}
TENDER = {"title": "$.Title", "published": "$.Pubdate", "area": "$.Province"}
COMPANY = {"name": "$.Name", "credit_code": "$.CreditCode", "person": "$.OperName", "capital": "$.RegistCapi", "status": "$.Status"}


def unwrapped(answers: DataFrame, company: str = "company", code: str = "code", answer: str = "answer", moment: str = "moment") -> DataFrame:
    """company, hits, verified, dishonest, findings, jobs, n_jobs, tenders: one row a company."""
    last = latest_per_key(answers.select(F.col(company).alias("company"), F.col(code).cast("string").alias("code"), F.col(answer).alias("answer"), F.col(moment).alias("moment")), ["company", "code"], [F.col("moment").desc_nulls_last(), F.col("answer").desc_nulls_last()])
    rows = last.withColumn("v", F.try_parse_json("answer")).where("v is not null and code is not null")
    ok = F.coalesce(F.try_variant_get("v", "$.Status", "string") == "200", F.lit(False))
    result, root = part(F.col("v"), "$.Result"), F.col("v")
    inside = is_object(result)
    none = F.expr("cast(array() as array<variant>)")
    held = F.coalesce(F.when(inside, items(result, "$.Data")).otherwise(items(result)), none)
    shaped = {
        SEARCH: ("hits", records(F.when(ok, F.coalesce(items(result), none)).otherwise(none), HIT)),
        RECRUITMENT: ("jobs", records(F.when(ok, F.coalesce(items(result), none)).otherwise(none), JOB)),
        TENDERS: ("tenders", records(F.when(ok, held).otherwise(none), TENDER)),
        DISHONEST: ("findings", records(F.when(ok, F.coalesce(F.when(inside, items(result, "$.Data")).otherwise(items(root, "$.Data")), none)).otherwise(none), FINDING)),
    }
    mark = part(F.when(inside, result).otherwise(root), "$.VerifyResult")
    total = F.coalesce(F.try_variant_get(root, "$.Paging.TotalRecords", "long"), F.size(F.coalesce(items(result), none)).cast("long"))
    data = part(result, "$.Data")
    one = F.when(ok & inside, F.coalesce(F.when(is_object(data), data), F.when(data.isNull(), result)))
    verified = F.when(one.isNotNull(), F.struct(*[F.try_variant_get(one, path, "string").alias(name) for name, path in COMPANY.items()]))
    each = [F.first(F.when(F.col("code") == c, value), ignorenulls=True).alias(name) for c, (name, value) in shaped.items()]
    each += [
        F.first(F.when(F.col("code") == VERIFY, verified), ignorenulls=True).alias("verified"),
        F.first(F.when(F.col("code") == DISHONEST, ok & mark.isNotNull()), ignorenulls=True).alias("dishonest"),
        F.first(F.when(F.col("code") == RECRUITMENT, F.when(ok, total).otherwise(0)), ignorenulls=True).alias("n_jobs"),
    ]
    found = rows.groupBy("company").agg(*each)
    everyone = last.select("company").distinct()
    return everyone.join(found, everyone["company"].eqNullSafe(found["company"]), "left").select(everyone["company"], "hits", "verified", "dishonest", "findings", "jobs", "n_jobs", "tenders")
