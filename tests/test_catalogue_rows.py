"""Catalogue rows whose searches have to move."""

from pyspark.sql import functions as F

from conftest import SF
from knnhard.operators import generate as G
from knnhard.operators import ivf
from knnhard.plans import fixtures as fx
from knnhard.plans import q_generate as Q
from knnhard.session import keep


def test_catalogue_rows_leave_their_searches_work(spark):
    """No start row has the empirical hardness that the catalogue's rows of an index ask for."""
    v = keep(fx.vectors(spark, SF))
    c, a = ivf.build_index(v)
    asked = [t for t in Q._TYPES if "target_low" in t]
    assert len(asked) == 2
    for t in asked:
        n = t["num_queries"]
        starts = G.start_points(v, n).unionByName(G.anneal_starts(v, n, 1234), allowMissingColumns=True).select(F.monotonically_increasing_id().alias("qid"), "qv")
        inside = ivf.hardness(v, keep(starts), c, a, Q.K).where(F.col("distcomp").between(t["target_low"], t["target_high"])).count()
        assert inside <= n // 4
