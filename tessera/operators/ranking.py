"""Scores of URLs: is it an endpoint that lists places, and by what is it asked?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact as C
from ..functions import records

#: Words and weights of a URL that lists places; parameters that tell how it is asked.
WEIGHTS = {r"store": 30, r"locator": 30, r"dealer|retailer|boutique": 25, r"location": 20, r"/api/|graphql|\.json": 20, r"search|find|nearby": 10, r"page=\d+": 5}
PENALTIES = {r"\.(?:css|js|png|jpe?g|gif|svg|woff2?)(?:$|\?)": 100, r"analytics|tracking|pixel|ads": 60}
KINDS = {"viewport": r"[?&](?:north|south|bounds|bbox|ne_?lat|sw_?lat)", "radius": r"[?&](?:radius|distance)=", "country": r"[?&](?:country|countrycode)=", "paginated": r"[?&](?:page|offset|cursor)="}
DENIED = r"\.(?:css|js|png|jpe?g|gif|svg|woff2?|ico|mp4)(?:$|\?)|google-analytics|doubleclick|facebook\.com|hotjar"


def endpoint_score(url: Column) -> Column:
    low, total = F.lower(url), F.lit(0)
    for pattern, weight in WEIGHTS.items():
        total = total + F.when(low.rlike(pattern), weight).otherwise(0)
    for pattern, weight in PENALTIES.items():
        total = total - F.when(low.rlike(pattern), weight).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def locator_kind(url: Column) -> Column:
    out = F.lit("single")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(F.lower(url).rlike(pattern), kind).otherwise(out)
    return out


def relevant(url: Column, allow: str = r"store|locat|dealer|retail|boutique|api|json|/en/|/fr/|/de/|/es/") -> Column:
    return F.coalesce(~F.lower(url).rlike(DENIED) & F.lower(url).rlike(allow), F.lit(False))


def ranked(pages: DataFrame, n: int = 48) -> DataFrame:
    """The best scored URLs; ties go by id."""
    return pages.select("page_id", "url", endpoint_score(F.col("url")).cast("long").alias("score"), locator_kind(F.col("url")).alias("kind"), C.detail_page(F.col("url")).alias("detail")).orderBy(F.desc("score"), "page_id").limit(n)


#: Fixed value: stores that an endpoint on a suspicious host must give to be trusted.
TRUSTED_STORES = 5
SUSPICIOUS = r"analytics|tracking|pixel|beacon|personali[sz]ation|doubleclick|segment\.|hotjar|ads"


def trust_group(url: Column, verified: Column, stores: Column) -> Column:
    """2 for verified endpoints with stores, 1 for unverified ones, 0 for a few stores on a suspicious host."""
    good = F.coalesce(verified, F.lit(False)) & (F.coalesce(stores, F.lit(0)) > 0)
    junk = good & F.lower(url).rlike(SUSPICIOUS) & (stores < TRUSTED_STORES)
    return F.when(good & ~junk, 2).when(~good, 1).otherwise(0)


def reranked(endpoints: DataFrame) -> DataFrame:
    """Endpoints (page_id, url, score, verified, stores) after verification: by group, score and number of stores."""
    grouped = endpoints.withColumn("trust", trust_group(F.col("url"), F.col("verified"), F.col("stores")))
    return grouped.orderBy(F.desc("trust"), F.desc("score"), F.desc(F.coalesce("stores", F.lit(0))), "page_id")


def strategy(config: Column, kind: Column, radius: Column, center: Column) -> Column:
    """How an endpoint's stores are fetched: by its brand's configuration (JSON), then by what its URL asks for.

    ``radius`` and ``center`` say whether the request has these parameters. The first branch that fits counts.
    """
    on = lambda name: ~F.coalesce(records.value(config, name), F.lit("")).isin("", "0", "false", "null", "[]", "{}")
    asked = lambda name: F.coalesce(F.trim(records.value(config, f"stores_by_api_countries.{name}")), F.lit(""))
    catalog = (asked("countries_url") != "") & F.contains(asked("stores_url_template"), F.lit("{country_id}"))
    urls = F.coalesce(records.value(config, "pagination_fetch_urls"), F.lit("")).rlike(r"^\[\s*[^\]\s]")
    around = radius & center
    return (
        F.when(on("post_per_country"), "post_per_country")
        .when(catalog, "stores_by_api_countries")
        .when(urls, "pagination_fetch_urls")
        .when(on("force_radius_multi_point") & (radius | on("radius")) & (center | on("radius_centers")), "radius_expansion")
        .when((kind == "paginated") & around, "radius_expansion")
        .when(kind == "paginated", "paginated")
        .when(kind == "viewport", "viewport_expansion")
        .when(kind == "country", "country_expansion")
        .when(((kind == "radius") | around) & ~on("force_single_call"), "radius_expansion")
        .when(on("geohash_prefix_expansion"), "geohash_prefixes")
        .otherwise("single_call")
    )
