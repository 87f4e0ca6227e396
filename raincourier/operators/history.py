"""Long-history analytics over the daily (or monthly) fact."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raincourier import settings as S
from raincourier.functions import rain, service
from raincourier.functions.numeric import complementary_error, ratio, rounded, whole

SUMS = ("orders", "exposed", "affected", "delayed", "sla_breaches")
COSTS = ("cost_transport", "cost_reship", "cost_sla")
ADDITIVE = (*SUMS, "delay_min_sum", *COSTS)


def weather_cost() -> Column:
    return F.col("cost_transport") + F.col("cost_reship") + F.col("cost_sla")


def agg_measures() -> list[Column]:
    """The standard measures of every breakdown."""
    return [*[F.sum(c).cast("bigint").alias(c) for c in SUMS],
            rounded(ratio(F.sum("delay_min_sum"), F.sum("affected")), 1).alias("avg_delay_min"),
            # A sum of thirds that should be a half is off by more than the twelfth decimal.
            rounded(F.sum(weather_cost()).cast("decimal(38,6)"), 0).alias("weather_cost")]


# ---- star and filters ------------------------------------------------------
def join_history_star(fact: DataFrame, routes: DataFrame, cities: DataFrame) -> DataFrame:
    dims = (routes.select("route_id", F.col("code").alias("route_code"), "warehouse_id", "hub_id", "city_id")
            .join(cities.select("city_id", F.col("name").alias("city_name"), "state"), "city_id"))
    return fact.join(dims, "route_id")


def join_category(star: DataFrame, categories: DataFrame) -> DataFrame:
    return star.join(categories.select("category_id", F.col("name").alias("category_name")), "category_id")


FILTER_COLUMNS = {"state": "state", "city": "city_id", "warehouse": "warehouse_id", "hub": "hub_id", "route": "route_id",
                  "category": "category_id", "severity": "severity"}


def _day(fact: DataFrame) -> Column:
    return F.col("month") if "month" in fact.columns else F.col("date")


def filter_history(fact: DataFrame, filters: dict) -> DataFrame:
    """Conjunction of the given filters; blank values are ignored."""
    day, conditions = _day(fact), []
    for key, value in filters.items():
        if value in (None, ""):
            continue
        if key == "year":
            # A date range, so that partition pruning and pushdown apply.
            conditions.append(day.between(F.make_date(F.lit(int(value)), F.lit(1), F.lit(1)),
                                          F.make_date(F.lit(int(value)), F.lit(12), F.lit(31))))
        elif key == "month":
            conditions.append(F.month(day) == int(value))
        else:
            conditions.append(F.col(FILTER_COLUMNS[key]) == value)
    return fact.filter(reduce(lambda a, b: a & b, conditions)) if conditions else fact


def filter_monsoon(fact: DataFrame) -> DataFrame:
    return fact.filter(F.month(_day(fact)).between(*S.MONSOON_MONTHS))


def filter_last_12_months(selected: DataFrame, whole_history: DataFrame) -> DataFrame:
    """Rows of the twelve months up to the latest month of the whole history
    (not just of the selection)."""
    first = whole_history.agg(F.add_months(F.trunc(F.max(_day(whole_history)), "month"), -11)).scalar()
    return selected.filter(_day(selected) >= first)


# ---- breakdowns ------------------------------------------------------------
def hist_totals(fact: DataFrame) -> DataFrame:
    return fact.agg(*agg_measures(), _first_day(fact), _last_day(fact))


def _first_day(fact):
    return F.min("first_day" if "first_day" in fact.columns else "date").alias("first_day")


def _last_day(fact):
    return F.max("last_day" if "last_day" in fact.columns else "date").alias("last_day")


def hist_monthly(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.date_format(_day(fact), "yyyy-MM").alias("month")).agg(*agg_measures())


def hist_yearly(fact: DataFrame) -> DataFrame:
    by_year = fact.groupBy(F.year(_day(fact)).alias("year")).agg(*agg_measures(), _first_day(fact), _last_day(fact))
    return by_year.withColumn("days", F.datediff("last_day", "first_day") + 1).drop("first_day", "last_day")


def hist_seasons(fact: DataFrame) -> DataFrame:
    by_month = fact.groupBy(F.month(_day(fact)).alias("m")).agg(*[F.sum(c).alias(c) for c in ADDITIVE])
    return by_month.groupBy(rain.season_of(F.col("m")).alias("season")).agg(*agg_measures())


def hist_geography(star: DataFrame, filters: dict | None = None, top: int = 25) -> DataFrame:
    """By state, by city once a state is chosen, by route once a city is; the
    costliest first."""
    filters = filters or {}
    if filters.get("city"):
        key, name = "route_id", "route_code"
    elif filters.get("state"):
        key, name = "city_id", "city_name"
    else:
        key, name = "state", "state"
    grouped = filter_history(star, filters).groupBy(F.col(key).alias("id")).agg(F.min(name).alias("name"), *agg_measures())
    return grouped.orderBy(F.desc_nulls_last("weather_cost"), "id").limit(top)


topk_geography = hist_geography


def hist_categories(star: DataFrame, categories: DataFrame) -> DataFrame:
    return (join_category(star, categories).groupBy(F.col("category_id").alias("id"))
            .agg(F.min("category_name").alias("name"), *agg_measures()).orderBy(F.desc("orders"), "id"))


def hist_severity(fact: DataFrame) -> DataFrame:
    return fact.groupBy("severity").agg(
        *agg_measures(), rounded(ratio(F.sum("delay_min_sum"), F.sum("exposed")), 1).alias("delay_per_exposed_min"),
        rounded(ratio(F.sum("sla_breaches"), F.sum("orders")), 4).alias("breach_rate"))


def hist_yoy_growth(fact: DataFrame) -> DataFrame:
    """Change in orders per covered day against the previous year."""
    per_day = F.col("orders") / F.greatest("days", F.lit(1))
    before = F.lag("per_day").over(W.orderBy("year"))
    return (hist_yearly(fact).select("year", "orders", "days", per_day.alias("per_day"))
            .withColumn("growth", rounded(ratio(F.col("per_day"), before) - 1, 4))
            .withColumn("per_day", rounded(F.col("per_day"), 4)))


def hist_per_1000(fact: DataFrame) -> DataFrame:
    orders = F.col("orders")
    return hist_yearly(fact).select(
        "year", "orders", rounded(ratio(F.col("weather_cost") * 1000, orders), 2).alias("cost_per_1000"),
        rounded(ratio(F.col("affected"), orders), 4).alias("affected_share"),
        rounded(ratio(F.col("exposed"), orders), 4).alias("exposed_share"))


def hist_heavy_vs_rain(fact: DataFrame) -> DataFrame:
    """How much worse a heavy-rain day is than a normal rainy or a dry one."""
    severity = hist_severity(fact)

    def of(name, column):
        return F.max(F.when(F.col("severity") == name, F.col(column)))

    return severity.agg(
        of("heavy", "delay_per_exposed_min").alias("heavy_delay_min"), of("rain", "delay_per_exposed_min").alias("rain_delay_min"),
        of("none", "breach_rate").alias("dry_breach_rate"), of("heavy", "breach_rate").alias("heavy_breach_rate"),
    ).withColumn("heavy_to_rain", rounded(F.col("heavy_delay_min") / F.greatest(F.lit(1.0), "rain_delay_min"), 1))


# ---- roll-ups --------------------------------------------------------------
MONTHLY_KEYS = ("month", "route_id", "category_id", "severity")


def mv_monthly(fact: DataFrame) -> DataFrame:
    """Monthly roll-up that the breakdowns can read instead of the daily fact."""
    return (fact.withColumn("month", F.trunc("date", "month")).groupBy(*MONTHLY_KEYS)
            .agg(*[F.sum(c).alias(c) for c in ADDITIVE], F.min("date").alias("first_day"), F.max("date").alias("last_day")))


def by_day(fact: DataFrame, of_class, *keys: str) -> DataFrame:
    """Daily roll-up by rain class and the keys given. `of_class(delay_min, breaches,
    orders)` gives the measures that follow from the sums of one class."""
    summed = ("orders", "affected", "delayed", "sla_breaches", "delay_min_sum")
    sums = fact.groupBy(*keys, "date", "severity").agg(*[F.sum(c).alias(c) for c in summed])
    return sums.withColumns(of_class(F.col("delay_min_sum"), F.col("sla_breaches"), F.col("orders")))


def weather_impact(fact: DataFrame) -> DataFrame:
    """Route × severity: days, sums and weather cost. Days are counted by
    reducing to (route, severity, date) first, so no group of dates is held."""
    daily = fact.withColumn("weather_cost", weather_cost()).groupBy("route_id", "severity", "date").agg(
        *[F.sum(c).alias(c) for c in ("orders", "exposed", "affected", "delay_min_sum", "weather_cost")])
    return daily.groupBy("route_id", "severity").agg(
        F.count("*").alias("days"), *[F.sum(c).alias(c) for c in ("orders", "exposed", "affected")],
        rounded(F.sum("delay_min_sum"), 2).alias("delay_min_sum"), rounded(F.sum("weather_cost"), 2).alias("weather_cost"))


def route_weather_impact(fact: DataFrame, routes: DataFrame) -> DataFrame:
    """Per route × severity: weather delay relative to normal travel time among
    affected orders, and the on-time share."""
    daily = fact.groupBy("route_id", "severity", "date").agg(
        *[F.sum(c).alias(c) for c in ("orders", "affected", "delay_min_sum", "sla_breaches")])
    grouped = daily.groupBy("route_id", "severity").agg(
        F.count("*").alias("days"), *[F.sum(c).alias(c) for c in ("orders", "affected", "delay_min_sum", "sla_breaches")])
    late = F.coalesce(ratio(F.col("delay_min_sum"), F.col("affected")), F.lit(0.0)) / (F.col("normal_eta_h") * 60)
    return grouped.join(routes.select("route_id", "normal_eta_h"), "route_id").select(
        "route_id", "severity", "days", rounded(late, 4).alias("delay_ratio"),
        rounded(1 - F.col("sla_breaches") / F.greatest("orders", F.lit(1)), 4).alias("on_time"))


def load_route_history(impact: DataFrame) -> DataFrame:
    """One row per route with the ratios of all four classes; routes that lack
    a class are dropped (they fall back to the delay model)."""
    wide = impact.groupBy("route_id").pivot("severity", list(S.RAIN_CLASSES)).agg(
        F.first("delay_ratio").alias("delay_ratio"), F.first("on_time").alias("on_time"))
    columns = [f"{c}_delay_ratio" for c in S.RAIN_CLASSES]
    return wide.dropna(subset=columns)


def structural_impact(star: DataFrame) -> DataFrame:
    """Long-run monsoon exposure per city."""
    return filter_monsoon(star).groupBy(F.col("city_id").alias("id"), "state").agg(
        F.sum("orders").cast("bigint").alias("orders"), rounded(ratio(F.sum("affected"), F.sum("orders")), 4).alias("affected_share"),
        rounded(ratio(F.sum("delay_min_sum"), F.sum("orders")), 2).alias("delay_per_order_min"),
        rounded(ratio(F.sum("sla_breaches"), F.sum("orders")), 4).alias("breach_rate"),
        rounded(ratio(F.sum(weather_cost()), F.sum("orders")), 2).alias("cost_per_order"))


def location_history(star: DataFrame, kind: str, id_: str):
    """(last twelve months by month, monsoon totals) of one location."""
    selected = filter_history(star, {kind: id_})
    return hist_monthly(filter_last_12_months(selected, star)), filter_monsoon(selected).agg(*agg_measures())


def options_distinct(fact: DataFrame, cities: DataFrame, warehouses: DataFrame, hubs: DataFrame, routes: DataFrame,
                     categories: DataFrame) -> DataFrame:
    """Filter choices as (kind, id, label), sorted for display. The sort is a
    range sort over all kinds, so long lists stay distributed."""
    def options(df, kind, id_, label, by=None):
        return df.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"),
                         F.col(label).cast("string").alias("label"), (F.col(label) if by is None else by).cast("string").alias("place"))

    years = fact.select(F.year(_day(fact)).alias("year")).distinct()
    severities = cities.sparkSession.range(len(S.RAIN_CLASSES)).select(rain.class_of_rank(F.col("id")).alias("severity"))
    parts = [options(years, "year", "year", "year"), options(cities.select("state").distinct(), "state", "state", "state"),
             options(cities, "city", "city_id", "name"), options(warehouses, "warehouse", "warehouse_id", "name"),
             options(hubs, "hub", "hub_id", "name"), options(routes, "route", "route_id", "code"),
             options(categories, "category", "category_id", "name"),
             options(severities, "severity", "severity", "severity", rain.severity_rank(F.col("severity")))]
    return reduce(DataFrame.unionByName, parts).orderBy("kind", "place", "id").drop("place")


# ---- expected history ------------------------------------------------------
def p_over(threshold: Column, mean: Column) -> Column:
    """P(delay > threshold) of a lognormal delay with this mean."""
    mu = F.log(mean) - S.DELAY_SIGMA ** 2 / 2
    z = (F.log(threshold) - mu) / S.DELAY_SIGMA
    return F.when(mean > 0, 0.5 * complementary_error(z / F.sqrt(F.lit(2.0)))).otherwise(0.0)


def expected_route_day(route_rain: DataFrame, routes: DataFrame, cities: DataFrame, shares: DataFrame) -> DataFrame:
    """Expected outcome per day × route × category from demand, the wettest
    reading on the route and the delay model; nothing is drawn at random.

    `route_rain`: route_id, date, rain_mm, severity. `shares`: category_id, share.
    """
    national = cities.agg(F.sum("demand")).scalar()
    normal, sensitivity = F.col("normal_eta_h"), F.col("sensitivity")
    # Everything that depends on route and class only is worked out once per
    # pair, not once per day.
    pairs = (routes.join(cities.select("city_id", "demand"), "city_id")
             .withColumn("severity", F.explode(F.array(*map(F.lit, S.RAIN_CLASSES))))
             .withColumn("mean_min", service.weather_delay_h(normal, sensitivity, F.col("severity")) * 60))
    breach = sum((F.lit(m) * p_over(F.greatest(F.lit(1e-6), (service.promised_h(normal, F.lit(t)) - normal) * 60), F.col("mean_min"))
                  for t, m in zip(S.TIERS, S.TIER_MIX)), F.lit(0.0))
    constants = pairs.select("route_id", "severity", "mean_min", (F.col("demand") / national * F.col("share")).alias("weight"),
                             breach.alias("p_weather_breach"), p_over(F.lit(30.0), F.col("mean_min")).alias("p_late"))
    days = route_rain.join(constants, ["route_id", "severity"])
    days = (days.withColumn("p_exposed", rain.exposure_probability(F.col("severity"), F.col("rain_mm")))
            .withColumn("volume", service.expected_orders(F.col("date")) * F.col("weight")))
    mix = shares.agg(F.collect_list(F.struct("category_id", "share"))).scalar()  # one entry per category
    rows = days.withColumn("part", F.explode(mix))
    orders = F.col("volume") * F.col("part.share")
    average_sla = sum(S.COST_SLA[t] * m for t, m in zip(S.TIERS, S.TIER_MIX))
    rows = (rows.withColumn("orders", orders).withColumn("exposed", F.col("orders") * F.col("p_exposed"))
            .withColumn("affected", F.col("exposed") * rain.per_class(F.col("severity"), S.P_AFFECTED))
            .withColumn("delay_min_sum", F.col("affected") * F.col("mean_min"))
            .withColumn("weather_breaches", F.col("affected") * F.col("p_weather_breach")))
    return rows.select(
        "date", "route_id", F.col("part.category_id").alias("category_id"), "severity", rounded(F.col("rain_mm"), 1).alias("rain_mm"),
        *[rounded(F.col(c), 3).alias(c) for c in ("orders", "exposed", "affected")],
        rounded(F.least(F.col("orders"), F.col("orders") * S.BASE_DELAYED_RATE + F.col("affected") * F.col("p_late")), 3).alias("delayed"),
        rounded(F.least(F.col("orders"), F.col("orders") * S.BASE_SLA_RATE + F.col("weather_breaches")), 3).alias("sla_breaches"),
        rounded(F.col("delay_min_sum"), 1).alias("delay_min_sum"),
        whole(F.col("delay_min_sum") / 60 * S.COST_PER_DELAY_HOUR).alias("cost_transport"),
        whole(F.col("exposed") * rain.per_class(F.col("severity"), S.FAILED_RATE) * S.COST_RESHIP).alias("cost_reship"),
        whole(F.col("weather_breaches") * average_sla).alias("cost_sla"))
