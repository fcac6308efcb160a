"""Requirements of a tender against a firm's profile, and the verdict over all of a tender's requirements.

A requirement has req_id, pos (its place), is_mandatory, phase, machine_checkable, check_field, check_operator, check_value (text) and
check_values (array, for regions), requirement_text and verbatim_quote; a profile has certifications, bonding_capacity, cgl_limit,
auto_limit, regions and submission_capabilities. A null or unusable value on either side gives `unknown`, never `fail`. Rows are judged one
by one; repeated req_ids of a tender count once, the first by pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount

#: Ways to submit, other words for them, names of portals, and hints in running text in the order in which they count.
METHODS = ("email", "fax", "in_person", "mail", "physical", "portal")
OTHER_WORDS = {"courier": "mail", "e-mail": "email", "facsimile": "fax", "hand delivery": "in_person", "hard copy": "physical", "in person": "in_person", "in-person": "in_person", "post": "mail"}
PORTALS = ("ariba", "biddingo", "bids&tenders", "bidsandtenders", "bonfire", "canadabuys", "merx")
HINTS = (
    (r"\be-?mail\b", "email"),
    (r"\b(?:procurement|bidding|submission) portal\b", "portal"),
    (r"\b(?:fax|facsimile)\b", "fax"),
    (r"\b(?:courier|mail|post)\b", "mail"),
    (r"\b(?:hand deliver|in[ -]person)\b", "in_person"),
    (r"\b(?:hard copy|physical)\b", "physical"),
)
#: Fields that rules can check, the operators each may have, and names that insurance goes by.
FIELD_OPERATORS = {"certification": ("==", "in"), "bonding_capacity": (">=",), "insurance_cgl": (">=",), "insurance_auto": (">=",), "region": ("==", "in"), "submission_method": ("==", "!=", "in")}
INSURANCE = {"insurance_cgl": "cgl_limit", "commercial general liability insurance": "cgl_limit", "insurance_auto": "auto_limit", "automobile liability insurance": "auto_limit"}
BID_PHASE = "bid_phase_mandatory"
PHASES = (BID_PHASE, "contract_condition", "not_a_requirement")


def methods(value: Column, context: Column | None = None) -> Column:
    """Ways to submit that a value names as a list; else the first that it and its context hint at; else none."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    items = F.transform(F.split(F.regexp_replace(F.replace(text, F.lit(","), F.lit("/")), r"\bor\b", "/"), "/"), lambda x: F.trim(x))
    other = F.create_map(*(F.lit(x) for kv in OTHER_WORDS.items() for x in kv))
    named = F.transform(items, lambda i: F.coalesce(F.try_element_at(other, i), F.replace(i, F.lit("-"), F.lit("_"))))
    named = F.array_sort(F.array_distinct(F.filter(named, lambda m: m.isin(*METHODS))))
    both = F.lower(F.concat_ws(" ", text, context)) if context is not None else text
    hint = F.when(text.contains("@"), "email")
    for k, (pattern, method) in enumerate(HINTS):
        if k == 1:
            for portal in PORTALS:
                hint = hint.when(both.contains(portal), "portal")
        hint = hint.when(both.rlike(pattern), method)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(hint)))


def comparable(found: Column) -> Column:
    """physical stands for handing in and mailing, and each of these for physical."""
    by_hand = F.arrays_overlap(found, F.array(F.lit("in_person"), F.lit("mail")))
    wide = F.when(F.array_contains(found, "physical"), F.array_union(found, F.array(F.lit("in_person"), F.lit("mail")))).otherwise(found)
    return F.array_sort(F.when(by_hand, F.array_union(wide, F.array(F.lit("physical")))).otherwise(wide))


def lowered(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def enough(needed: Column, held: Column) -> Column:
    return F.when(needed.isNull() | held.isNull(), "unknown").when(held >= needed, "pass").otherwise("fail")


def evaluate_rules(pairs: DataFrame) -> DataFrame:
    """Rows of a requirement beside a profile, with outcome: pass, fail or unknown."""
    field, value = F.lower(F.trim(F.coalesce("check_field", F.lit("")))), F.trim(F.coalesce("check_value", F.lit("")))
    rows = pairs.withColumns({
        "_wanted": comparable(methods(F.col("check_value"), F.concat_ws(" ", "requirement_text", "verbatim_quote"))),
        "_able": comparable(F.array_distinct(F.flatten(F.transform(F.coalesce("submission_capabilities", F.array().cast("array<string>")), lambda c: methods(c))))),
        "_regions": F.when(F.size(lowered(F.col("check_values"))) > 0, lowered(F.col("check_values"))).otherwise(lowered(F.array("check_value"))),
    })
    needed, op = amount(F.col("check_value")), F.trim(F.coalesce("check_operator", F.lit("")))
    certificate = F.when(value == "", "unknown").when(F.array_contains(lowered(F.col("certifications")), F.lower(value)), "pass").otherwise("fail")
    region = F.when(F.size("_regions") == 0, "unknown").when(F.arrays_overlap("_regions", lowered(F.col("regions"))), "pass").otherwise("fail")
    how = F.when((F.size("_wanted") == 0) | ~op.isin("==", "!=", "in"), "unknown")
    how = how.when(op == "!=", F.when(F.size(F.array_except("_able", "_wanted")) > 0, "pass").otherwise("fail"))
    how = how.when(F.arrays_overlap("_wanted", "_able"), "pass").otherwise("fail")
    outcome = F.when(~F.coalesce("machine_checkable", F.lit(False)), "unknown").when(field == "certification", certificate).when(field == "bonding_capacity", enough(needed, F.col("bonding_capacity")))
    for name, limit in INSURANCE.items():
        outcome = outcome.when(field == name, enough(needed, F.col(limit)))
    outcome = outcome.when(field == "region", region).when(field == "submission_method", how).otherwise("unknown")
    return rows.withColumn("outcome", outcome).drop("_wanted", "_able", "_regions")


def checkable(rows: DataFrame) -> DataFrame:
    """Requirements whose field or operator can't be checked lose machine_checkable."""
    field, op = F.lower(F.trim(F.coalesce("check_field", F.lit("")))), F.trim(F.coalesce("check_operator", F.lit("")))
    known = F.lit(False)
    for name, ops in FIELD_OPERATORS.items():
        known = known | (field == name) & op.isin(*ops)
    return rows.withColumn("machine_checkable", F.coalesce("machine_checkable", F.lit(False)) & known)


def bid_phase(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("is_mandatory", F.lit(False)) & F.col("phase").eqNullSafe(F.lit(BID_PHASE)))


def with_phases(requirements: DataFrame, judged: DataFrame) -> DataFrame:
    """Phases by tender and req_id; invalid, unknown and missing ones are the bid phase; of repeated ones the last by pos counts."""
    said = judged.withColumn("phase", F.lower(F.trim("phase"))).where(F.col("phase").isin(*PHASES))
    said = said.groupBy("tender_id", "req_id").agg(F.max_by("phase", "pos").alias("_phase"))
    return requirements.join(said, ["tender_id", "req_id"], "left").withColumn("phase", F.coalesce("_phase", F.lit(BID_PHASE))).drop("_phase")


def with_judgments(asked: DataFrame, judged: DataFrame) -> DataFrame:
    """asked requirements with verdict, rationale and source: of a requirement's judgments the first by pos counts, a verdict that is none of
    the three is coerced to uncertain, a missing one defaults to it; judgments of other ids are left out."""
    first = judged.groupBy("tender_id", "req_id").agg(F.min_by(F.struct("verdict", "rationale"), "pos").alias("_j"))
    rows = asked.join(first, ["tender_id", "req_id"], "left")
    said = F.lower(F.trim(F.coalesce("_j.verdict", F.lit("uncertain"))))
    valid = said.isin("satisfied", "not_satisfied", "uncertain")
    return rows.withColumns({
        "verdict": F.when(valid, said).otherwise("uncertain"),
        "rationale": F.when(F.col("_j").isNull(), "No valid judgment was returned.").otherwise(F.coalesce(F.nullif(F.trim("_j.rationale"), F.lit("")), F.lit("The model did not provide a rationale."))),
        "source": F.when(F.col("_j").isNull(), "defaulted").when(valid, "explicit").otherwise("coerced"),
    }).drop("_j")


def missing(asked: DataFrame, judged: DataFrame) -> DataFrame:
    """Requirements of a batch without a judgment, to be asked again."""
    return asked.join(judged.select("tender_id", "req_id").distinct(), ["tender_id", "req_id"], "left_anti")


def decide(tenders: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row for each tender_id: verdict, confidence, blockers, open_questions (req_ids by pos), rationale and counts.

    outcomes has tender_id, req_id, pos, requirement_text, outcome and fuzzy (whether a judge was needed). No requirement means review with
    low confidence. The longest list is a tender's requirements, which the result returns.
    """
    first = outcomes.groupBy("tender_id", "req_id").agg(F.min_by(F.struct("pos", "requirement_text", "outcome", "fuzzy"), "pos").alias("r")).select("tender_id", "req_id", "r.*")
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("outcome", F.lit("unknown")) == kind, F.struct("pos", "req_id", F.trim(F.coalesce("requirement_text", F.lit(""))).alias("text"))))), lambda x: F.struct(x["req_id"].alias("id"), x["text"].alias("text")))
    rows = first.groupBy("tender_id").agg(F.count("*").alias("mandatory"), F.count(F.when(F.col("outcome") == "pass", 1)).alias("passed"), of("fail").alias("f"), of("unknown").alias("u"), F.max("fuzzy").alias("fuzzy"))
    rows = tenders.select("tender_id").distinct().join(rows, "tender_id", "left")
    none = F.array().cast("array<struct<id:string,text:string>>")
    rows = rows.select("tender_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("mandatory", "passed")), F.coalesce("f", none).alias("f"), F.coalesce("u", none).alias("u"), F.coalesce("fuzzy", F.lit(False)).alias("fuzzy"))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    reason = lambda head, c: F.concat(F.lit(f"{head}: "), F.array_join(F.transform(F.slice(c, 1, 3), lambda x: F.concat(x["id"], F.lit(" ("), x["text"], F.lit(")"))), "; "), F.when(F.size(c) > 3, F.concat(F.lit(" and "), (F.size(c) - 3).cast("string"), F.lit(" more"))).otherwise(""), F.lit("."))
    empty = F.col("mandatory") == 0
    doubt = F.size("u") >= F.greatest(F.lit(2), F.floor(F.col("mandatory") / 2))
    return rows.select(
        "tender_id",
        F.when(empty, "review").when(F.size("f") > 0, "no_bid").when(F.size("u") > 0, "review").otherwise("bid").alias("verdict"),
        F.when(empty | doubt, "low").when(F.col("fuzzy"), "medium").otherwise("high").alias("confidence"),
        ids("f").alias("blockers"),
        ids("u").alias("open_questions"),
        F.when(empty, "No requirements extracted; manual review is required.").when(F.size("f") > 0, reason("Do not bid", F.col("f"))).when(F.size("u") > 0, reason("Manual review required", F.col("u"))).otherwise("Bid: the profile satisfies every extracted mandatory requirement.").alias("rationale"),
        "mandatory",
        "passed",
        F.size("f").alias("failed"),
        F.size("u").alias("uncertain"),
    )
