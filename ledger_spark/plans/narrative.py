"""Insight records: decoded advice replies, or figures with a template's words."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.render import money_text, percent_text
from ledger_spark.keyed import join_on_keys
from ledger_spark.sources.replies import decode_advice


@dataclass(frozen=True)
class Template:
    """What to say about an account that no model has described.

    The caller words ``tips`` and ``advice``; the figures come first.
    """

    tips: tuple[str, ...]
    advice: str
    with_savings_rate: bool = True


def _figures(template: Template) -> Column:
    parts = [
        F.lit("in "),
        money_text(F.col("total_income")),
        F.lit(", out "),
        money_text(F.col("total_expenses")),
        F.lit(", left "),
        money_text(F.col("net_flow")),
    ]
    if template.with_savings_rate:
        rate = F.coalesce(percent_text(F.col("avg_savings_rate")), F.lit("n/a"))
        parts += [F.lit(", saved "), rate]
    return F.concat(*parts)


def _insight(template: Template) -> Column:
    return F.struct(
        _figures(template).alias("summary"),
        F.array(*[F.lit(t) for t in template.tips]).alias("tips"),
        F.lit(template.advice).alias("custom_advice"),
    )


def template_narrative(
    summaries: DataFrame, template: Template, keys: Sequence[str] = ()
) -> DataFrame:
    """Figures, tips and advice per key."""
    insight = summaries.select(*keys, _insight(template).alias("insight"))
    return insight.select(*keys, "insight.*")


def insights(
    facts: DataFrame,
    refused: Template,
    failed: Template,
    replies: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Insight record per key: summary, tips, health score, custom advice.

    ``facts`` holds the summary columns and ``health_score``. ``replies`` has
    the keys, ``attempt`` (number or time), ``status`` (HTTP code) and
    ``response``; of several replies of a key the last attempt counts. A refused
    request and an unreadable or missing reply fall back to their templates.
    """
    if replies is None:
        chosen = _insight(failed)
        joined = facts
    else:
        last = F.max(F.struct("attempt", "status", "response")).alias("last")
        latest = replies.groupBy(*keys).agg(last)
        content = F.get_json_object("last.response", "$.choices[0].message.content")
        answers = latest.select(
            *keys, F.col("last.status").alias("__status"), decode_advice(content).alias("__advice")
        )
        # without keys both sides have a single row
        joined = (
            join_on_keys(facts, answers, keys, "left")
            if keys
            else facts.crossJoin(F.broadcast(answers))
        )
        was_refused = F.col("__status").isNotNull() & (F.col("__status") != 200)
        chosen = F.when(was_refused, _insight(refused)).otherwise(
            F.coalesce("__advice", _insight(failed))
        )
    picked = joined.select(*keys, "health_score", chosen.alias("insight"))
    return picked.select(
        *keys, "insight.summary", "insight.tips", "health_score", "insight.custom_advice"
    )
