"""What keeps a firm from bidding, said in a sentence: blockers of decisions with their quotes, the one to show, and its reason.

decisions has tender_id, verdict, blockers and open_questions (ids in order); requirements has tender_id, req_id, requirement_text,
verbatim_quote, page_number and check_value. Only blockers of "no_bid" whose requirement has a quote are evidence. Of repeated requirements the
smallest text stands. Null texts are empty; tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = ("requirement_text", "verbatim_quote", "page_number", "check_value")


def evidence(decisions: DataFrame, requirements: DataFrame) -> DataFrame:
    """tender_id, pos, req_id and EVIDENCE of every blocker with a quote."""
    each = decisions.where("verdict = 'no_bid'").select("tender_id", F.posexplode("blockers").alias("pos", "req_id"))
    known = requirements.groupBy("tender_id", "req_id").agg(F.min(F.struct(*EVIDENCE)).alias("r")).select("tender_id", "req_id", "r.*").where("verbatim_quote != ''")
    return each.join(known, ["tender_id", "req_id"]).select("tender_id", "pos", "req_id", *EVIDENCE)


def first_of_each(decisions: DataFrame, requirements: DataFrame) -> DataFrame:
    """evidence() of each tender's first blocker; a tender whose first has no quote has none."""
    return evidence(decisions, requirements).where("pos = 0")


def preferred(found: DataFrame, wanted: str | None = "fax") -> DataFrame:
    """One row: the first by tender and place whose value, quote or text holds the wanted word in any case, else the first of all."""
    holds = F.lit(False)
    if wanted:
        for c in ("check_value", "verbatim_quote", "requirement_text"):
            holds = holds | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted.casefold()))
    order = F.struct(F.when(holds, 0).otherwise(1).alias("k"), "tender_id", "pos")
    return found.agg(F.min_by(F.struct(*found.columns), order).alias("b")).where("b is not null").select("b.*")


def reason(check_value: Column, quote: Column, text: Column, capabilities: Column) -> Column:
    """The sentence: what is required, and how the firm submits."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hay, method = F.concat(low(quote), F.lit(" "), low(text)), F.trim(low(check_value))
    needs = F.when(hay.contains("fax") | hay.contains("facsimile") | (method == "fax"), "fax submission").when(method.contains("physical") | hay.contains("deliver"), "physical delivery")
    able = F.coalesce(capabilities, F.array().cast("array<string>"))
    electronic = (F.size(able) > 0) & (F.size(F.array_except(able, F.array(F.lit("email"), F.lit("portal")))) == 0)
    ways = F.coalesce(F.nullif(F.array_join(able, " and "), F.lit("")), F.lit("other means"))
    tail = F.when(electronic, "this firm submits electronically only").otherwise(F.concat(F.lit("this firm submits by "), ways, F.lit(" only")))
    return F.concat(F.lit("Requires "), F.coalesce(needs, F.lit("a submission method this firm does not support")), F.lit(" — "), tail, F.lit("."))


def strays(decisions: DataFrame, requirements: DataFrame) -> DataFrame:
    """tender_id and req_id that a decision names and its requirements lack: none in sound data."""
    named = decisions.select("tender_id", F.explode(F.array_union("blockers", "open_questions")).alias("req_id"))
    return named.join(requirements.select("tender_id", "req_id").distinct(), ["tender_id", "req_id"], "left_anti")
