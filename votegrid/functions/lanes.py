"""The fourteen feature lanes and their quantisation, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from votegrid.functions.moments import epoch_seconds, weekday
from votegrid.plans.config import CATEGORY_RISK, DEFAULT_RISK, DIM, FLAG_LANES, Normalization


def clamp(x: Column) -> Column:
    """To [0, 1]; NaN becomes 0.  Null stays null, unlike ``greatest``."""
    return F.when(F.isnan(x), 0.0).when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def ratio(x: Column, y: Column, otherwise: float = 1.0) -> Column:
    """x / y where y is positive."""
    return F.when(y > 0, x / y).otherwise(otherwise)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes, never negative."""
    return F.greatest(F.lit(0), epoch_seconds(later) - epoch_seconds(earlier)) / 60.0


def lookup(table: Mapping[str, float], key: Column, default: float) -> Column:
    """A small literal map with a default."""
    if not table:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def category_risk(code: Column, table: Mapping[str, float] = CATEGORY_RISK) -> Column:
    return lookup(table, code, DEFAULT_RISK)


def category_risk_by_number(code: Column, table: Mapping[str, float] = CATEGORY_RISK) -> Column:
    """The same for integer codes; keys that are no integers are left out."""
    numbers = {int(k): v for k, v in table.items() if k.strip().lstrip("+-").isdigit()}
    return lookup(numbers, code, DEFAULT_RISK)


def feature_lanes(
    n: Normalization = Normalization(), table: Mapping[str, float] = CATEGORY_RISK
) -> list[Column]:
    """Fourteen doubles from the flat request columns (see ``sources.requests``)."""
    c = F.col
    prior = c("last_at").isNotNull()
    return [
        clamp(c("amount") / n.max_amount),
        clamp(c("installments") / n.max_installments),
        F.when(c("customer_avg") > 0, clamp(c("amount") / c("customer_avg") / n.amount_vs_avg_ratio)).otherwise(1.0),
        F.hour("requested_at") / 23.0,
        weekday(c("requested_at")) / 6.0,
        F.when(prior, clamp(minutes_between(c("requested_at"), c("last_at")) / n.max_minutes)).otherwise(-1.0),
        F.when(prior, clamp(c("last_km") / n.max_km)).otherwise(-1.0),
        clamp(c("km_from_home") / n.max_km),
        clamp(c("tx_count_24h") / n.max_tx_count_24h),
        c("is_online").cast("double"),
        c("card_present").cast("double"),
        F.when(F.array_contains("known_merchants", c("merchant_id")), 0.0).otherwise(1.0),
        category_risk(c("mcc"), table),
        clamp(c("merchant_avg") / n.max_merchant_avg_amount),
    ]


def quantize_lane(x: Column, scale: int = Normalization.scale) -> Column:
    """Nearest step, halves away from zero, saturated to 16 bits."""
    step = F.round(x * float(scale))
    return F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), step)).cast("smallint")


def truncate_lane(x: Column, scale: int = Normalization.scale) -> Column:
    """Flag lanes of arbitrary reference vectors are cut, not rounded."""
    return F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), x * float(scale))).cast("smallint")


def quantize(lanes: list[Column], scale: int = Normalization.scale) -> Column:
    """ARRAY<SMALLINT> of the fourteen lanes."""
    return F.array(*[(truncate_lane if k in FLAG_LANES else quantize_lane)(x, scale) for k, x in enumerate(lanes)])


def array_lanes(vector: Column) -> list[Column]:
    return [F.get(vector, F.lit(k)) for k in range(DIM)]
