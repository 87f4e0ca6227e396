"""Long-history queries."""
from raincourier.operators import climate, history
from raincourier.plans.catalog import query
from raincourier.functions.numeric import rounded
from pyspark.sql import functions as F

FILTERS = {"year": "1998", "month": 7, "state": "ASIA", "severity": "heavy", "city": "", "route": None}


def star(lake, *needs):
    return history.join_history_star(lake.history("route", *needs), lake.routes, lake.cities)


def daily_star(lake):
    return history.join_history_star(lake.route_days, lake.routes, lake.cities)


@query()
def join_history_star(lake):
    return star(lake).groupBy("route_id", "route_code", "warehouse_id", "hub_id", "city_id", "city_name", "state").agg(F.count("*").alias("rows"))


@query()
def join_category(lake):
    return (history.join_category(lake.history("category"), lake.categories).groupBy("category_id", "category_name")
            .agg(F.count("*").alias("rows"), F.sum("exposed").alias("exposed")))


@query()
def agg_measures(lake):
    return lake.history("category").groupBy("category_id", "severity").agg(*history.agg_measures())


@query()
def filter_history(lake):
    return history.filter_history(star(lake, "category"), FILTERS).groupBy("city_id", "category_id").agg(*history.agg_measures())


@query()
def filter_monsoon(lake):
    return history.filter_monsoon(lake.days).groupBy(F.month("date").alias("month")).agg(*history.agg_measures())


@query()
def filter_last_12_months(lake):
    fact = lake.history()
    return history.filter_last_12_months(fact, fact).groupBy(F.trunc("date", "month").alias("month")).agg(*history.agg_measures())


@query()
def hist_totals(lake):
    return history.hist_totals(lake.days)


@query()
def hist_monthly(lake):
    return history.hist_monthly(lake.days)


@query()
def hist_yearly(lake):
    return history.hist_yearly(lake.days)


@query()
def hist_seasons(lake):
    return history.hist_seasons(lake.days)


@query()
def hist_geography(lake):
    return history.hist_geography(daily_star(lake))


@query()
def topk_geography(lake):
    return history.hist_geography(daily_star(lake), {"city": "C2"})


@query()
def hist_categories(lake):
    return history.hist_categories(lake.history("category"), lake.categories)


@query()
def hist_severity(lake):
    return history.hist_severity(lake.days)


@query()
def hist_yoy_growth(lake):
    return history.hist_yoy_growth(lake.days)


@query()
def hist_per_1000(lake):
    return history.hist_per_1000(lake.days)


@query()
def hist_heavy_vs_rain(lake):
    return history.hist_heavy_vs_rain(lake.days)


def _money(df, *columns):
    return df.withColumns({c: rounded(F.col(c), 2) for c in columns})


@query()
def mv_monthly(lake):
    return _money(history.mv_monthly(lake.history("route", "category")), "delay_min_sum", *history.COSTS)


@query()
def weather_impact(lake):
    return history.weather_impact(lake.history("route"))


@query()
def route_weather_impact(lake):
    return history.route_weather_impact(lake.history("route"), lake.routes)


@query()
def structural_impact(lake):
    return history.structural_impact(daily_star(lake))


@query()
def location_history(lake):
    months, monsoon = history.location_history(daily_star(lake), "state", "ASIA")
    return months.unionByName(monsoon.withColumn("month", F.lit("monsoon")))


@query()
def options_distinct(lake):
    return history.options_distinct(lake.days, lake.cities, lake.warehouses, lake.hubs, lake.routes, lake.categories)


@query()
def expected_route_day(lake):
    route_rain = climate.join_route_day_rain(lake.routes, lake.daily_rain())
    return history.expected_route_day(route_rain, lake.routes, lake.cities, lake.category_shares())
