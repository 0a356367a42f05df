"""Frames by pointers against the fold over each video."""

import random

import pytest

from skriva.operators import frame_chain
from skriva.plans.registry import written


def fold(frames, scene, floor, most):
    """The frames of one video in order, as the definition has it."""
    out, last = [], None
    for t, s in sorted(frames, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        if len(out) < most and (last is None or s is not None and s >= scene or t - last >= floor):
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("scene,floor,most,span", [(0.9, 30.0, 40, 4000), (0.5, 7.5, 5, 300), (1.5, 2.0, 200, 900), (0.7, 0.0, 9, 50), (0.99, 30.0, 1, 100)])
def test_as_the_fold(spark, scene, floor, most, span):
    r = random.Random(span)
    videos = {name: [(r.randrange(-span if name == "b" else 0, span * 4) / 4, r.choice([None, r.random(), 0.95])) for _ in range(n)] for name, n in [("a", 900), ("b", 300), (None, 200), ("c", 1), ("d", 40)]}
    videos["d"] += [(5.0, 0.99)] * 60 + [(5.0, 0.1)] * 10
    rows = [(v, t, s) for v, f in videos.items() for t, s in f] + [("a", None, 0.99), ("none", None, None)]
    r.shuffle(rows)
    got = frame_chain.sample_frames(spark.createDataFrame(rows, "v string, t double, scene double"), "v", written, scene, floor, most)
    want = [(v, t) for v, f in videos.items() for t in fold(f, scene, floor, most)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_long_video_in_many_tasks(spark):
    """A video of 300,000 frames whose first chain is longer than what is asked for, and one without a frame."""
    frames = spark.range(300_000).selectExpr("'long' AS v", "id / 30D AS t", "0.1D AS scene")
    got = frame_chain.sample_frames(frames, "v", written)
    assert sorted(r.t for r in got.collect()) == [30.0 * i for i in range(40)]
    assert frame_chain.sample_frames(frames.limit(0), "v", written).count() == 0
