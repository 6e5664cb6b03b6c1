"""Tables of model replies merged back into rows; anything unusable falls back to rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import categorize
from ..functions.values import default_currency, is_outflow, strip
from ..schema import CATEGORIES, MONEY

_FENCE = r"(?m)^```(?:json)?\s*|\s*```$"
_ITEM = "date string, description string, amount string"


def reply_items(reply: Column) -> Column:
    """The JSON array of a reply, fences and prose around it dropped; null when there is none."""
    clean = strip(F.regexp_replace(reply, _FENCE, ""))
    inside = F.regexp_extract(clean, r"(?s)\[.*\]", 0)
    return F.from_json(F.when(inside == "", clean).otherwise(inside), "array<string>")


def apply_model_labels(batches: DataFrame) -> DataFrame:
    """batch_id, descriptions, reply -> batch_id, pos, description, category.

    The reply belongs to its batch, so items are matched by position in the row itself and
    no join is needed. A missing or unknown item takes the rule category, a bad reply the
    rule categories for the whole batch.
    """
    lines = batches.select("batch_id", reply_items(F.col("reply")).alias("items"),
                           F.posexplode("descriptions").alias("pos", "description"))
    label = F.lower(F.get("items", F.col("pos")))
    return lines.select(
        "batch_id", "pos", "description",
        F.when(label.isin(*CATEGORIES), label).otherwise(categorize(F.col("description")))
        .alias("category"))


def parse_extractions(replies: DataFrame, run_date: str) -> DataFrame:
    """reply_id, reply (JSON object with ``transactions``) -> transactions in order.

    An unreadable date becomes ``run_date``; rows without a readable amount, or with zero,
    are left out.
    """
    text = strip(F.regexp_replace("reply", "```(?:json)?|```", ""))
    parsed = F.from_json(text, f"transactions array<struct<{_as_struct(_ITEM)}>>")
    items = replies.select("reply_id", F.posexplode(parsed["transactions"]).alias("pos", "item"))
    iso = F.substring(F.col("item.date"), 1, 10)
    day = F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(iso, "yyyyMMdd"),
                     F.to_date(F.lit(run_date)))
    description = strip(F.substring(F.coalesce(F.col("item.description"), F.lit("unknown")),
                                    1, 120))
    amount = strip(F.coalesce(F.col("item.amount"), F.lit("0"))).try_cast(MONEY)
    rows = items.select("reply_id", "pos", day.alias("txn_date"),
                        description.alias("description"), amount.alias("amount"))
    rows = rows.where(F.col("amount").isNotNull() & (F.col("amount") != 0))
    return rows.withColumns({
        "currency": default_currency(F.lit(None).cast("string")),
        "category": categorize(F.col("description")),
        "is_outflow": is_outflow(F.col("amount"))})


def _as_struct(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))
