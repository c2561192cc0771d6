"""Where redirects lead, from a table of single hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.storage import released, stored

#: Hops that are followed before a chain counts as too long.
MOST_HOPS = 5


def resolve(starts: DataFrame, hops: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """``site, url, final_url, redirect_chain, outcome`` for each of ``site, url``.

    ``hops``: ``site, url, location``, an address and where it sends to (may be relative).  All chains take a hop in each round, by
    one join; those that have ended leave the rounds.  Addresses are met in normal form.  Outcomes: ``ok``; ``loop``, an address
    for the second time; ``private``, a hop to a host that isn't public or an address that isn't one, which is not followed; ``too_many``,
    more than ``most_hops``.  The chain has every address visited, the first one included; it is empty without a redirect.
    Of several locations of an address the least counts; null addresses stay where they are.
    """
    norm = lambda c: F.coalesce(urls.normalize(c), c)
    table = hops.filter("url IS NOT NULL AND location IS NOT NULL").select(F.col("site").alias("_s"), norm(F.col("url")).alias("_u"), norm(urls.resolve(F.col("url"), F.col("location"))).alias("_next")).groupBy("_s", "_u").agg(F.min("_next").alias("_next"))
    table = stored(table, "hops")
    live = stored(starts.select("site", "url", norm(F.col("url")).alias("here"), F.array(norm(F.col("url"))).alias("chain")), "chains")
    done = []
    for n in range(most_hops + 1):
        met = live.join(table, (F.col("site") == F.col("_s")) & (F.col("here") == F.col("_u")), "left")
        private = F.coalesce(urls.is_private(F.col("_next")) | urls.normalize(F.col("_next")).isNull(), F.lit(False))
        outcome = F.when(F.col("_next").isNull(), "ok").when(F.array_contains("chain", F.col("_next")), "loop").when(private, "private").when(F.lit(n == most_hops), "too_many")
        step = stored(met.withColumn("outcome", outcome), "chains")
        ended = F.when(F.col("outcome") == "loop", F.concat("chain", F.array("_next"))).otherwise(F.col("chain"))
        done.append(step.filter("outcome IS NOT NULL").select("site", "url", F.col("here").alias("final_url"), ended.alias("redirect_chain"), "outcome"))
        released(live)
        live = stored(step.filter("outcome IS NULL").select("site", "url", F.col("_next").alias("here"), F.concat("chain", F.array("_next")).alias("chain")), "chains")
        if live.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.withColumn("redirect_chain", F.when(F.size("redirect_chain") > 1, F.col("redirect_chain")).otherwise(F.array().cast("array<string>")))
