"""SRC15: stored model answers -> validated people."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import people as P
from rostrum.functions import text as T

PEOPLE = "ARRAY<STRUCT<name: STRING, designation: STRING>>"


def json_body(answer: Column) -> Column:
    """Text inside a code fence, else the whole answer."""
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    return T.let(answer, lambda a: F.trim(F.when(a.rlike(fence), F.regexp_extract(a, fence, 1)).otherwise(a)))


def parse_people(answer: Column) -> Column:
    """Strict parse, then a second try on the outermost bracket span."""
    def second(body: Column) -> Column:
        span = F.regexp_extract(body, r"[\[{][\s\S]*[\]}]", 0)
        return F.coalesce(F.from_json(F.when(body.startswith("["), body), PEOPLE), F.from_json(F.when(span.startswith("["), span), PEOPLE))

    return T.let(json_body(answer), second)


def validated_people(answers: DataFrame) -> DataFrame:
    """``(answer_id, company_name, answer)`` -> people with a valid name and a role."""
    parsed = T.once(answers, people=parse_people(F.col("answer")))
    rows = (parsed.select("answer_id", "company_name", F.posexplode("people").alias("pos", "p"))
            .where(F.col("p.name").isNotNull()))
    rows = T.once(rows, person_name=P.clean_name(F.col("p.name")))
    valid = rows.where(P.is_person_name(F.col("person_name"), T.company_words(F.col("company_name"))))
    return (valid.select("answer_id", "pos", "person_name", P.normalize_role(F.coalesce("p.designation", F.lit(""))).alias("designation"))
            .where(F.col("designation") != ""))
