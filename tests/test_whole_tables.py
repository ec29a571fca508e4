"""Queries without an oracle, held against the whole table."""

import os

import numpy as np
import pytest

from cairn.operators import graph
from cairn.plans import graphs, retrieval

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_mmr_starts_from_the_nearest_of_all(spark):
    got = retrieval.mmr_rerank(spark, SF).collect()
    q = np.array(retrieval.QVEC)
    far = {r["id"]: float(np.linalg.norm(np.array(r["embedding"], dtype=float) - q)) for r in retrieval.vectors(spark, SF).collect()}
    near = sorted(far, key=lambda i: (far[i], i))
    assert len(got) == 20 and {r["target_id"] for r in got} <= set(near[:60])
    assert min(got, key=lambda r: r["mmr_rank"])["target_id"] == near[0]


def test_summary_lane_takes_all_passes(spark, monkeypatch):
    seen, real = [], graph.communities
    monkeypatch.setattr(graph, "communities", lambda e, passes=20: (seen.append(passes), real(e, passes))[1])
    graphs.community_summary_lane(spark, SF)
    assert seen == [20]
