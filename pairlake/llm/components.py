"""Connected components of a link table by alternating star contraction.

Every round is two grouped minima and two joins over the links, so a node with
a third of all links costs one partial row per task in the minima and is split
by the skew join.  Rounds are cut by reliable checkpoints; nothing is gathered
on the driver but a count and a checksum per round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.operators.index import pin


def _stars(links: DataFrame, centre: str, leaf: str) -> DataFrame:
    """Append ``m``: the least of the centre and its leaves."""
    least = links.groupBy(centre).agg(F.min(leaf).alias("m"))
    return links.join(least, centre).withColumn("m", F.least(centre, "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (_stars(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = _stars(down, "a", "b")
    return (stars.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(stars.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: any orderable type) -> (node, root) for every node that
    is not the least of its component; ``root`` is that least node.

    Self-links and repeated links are allowed; rows with a null end are no
    links; no links give no rows."""
    current = pin(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct())
    state = _state(current)
    while state[0]:
        current = pin(_small_star(_large_star(current)))
        before, state = state, _state(current)
        if tuple(before) == tuple(state):
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
