"""Farthest points against the plain algorithm over all rows."""

import random


from quarrylight.operators import sampling




def plain(points, n):
    left, chosen = list(points), []
    far = lambda p, q: (p[1] - q[0]) ** 2 + (p[2] - q[1]) ** 2
    for i in range(min(n, len(points))):
        if i < 4:
            p = min(left, key=lambda p: (far(p, ((0, 0), (0, 1), (1, 0), (1, 1))[i]), p[1], p[0]))
        else:
            p = min(left, key=lambda p: (-min(far(p, q[1:]) for q in chosen), p[1], p[0]))
        chosen.append(p)
        left.remove(p)
    return [p[0] for p in chosen]


def test_points_inside_a_cell(spark):
    rng = random.Random(3)
    points = [(i, rng.random(), rng.random()) for i in range(30000)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = [r.id for r in sampling.farthest(df, "id", "x", "y", 20).orderBy("pick").collect()]
    assert got == plain(points, 20)


def test_fewer_points_than_picks(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("b", 1.0, 1.0), ("c", None, 0.5)], "id string, x double, y double")
    assert [r.id for r in sampling.farthest(df, "id", "x", "y", 5).orderBy("pick").collect()] == ["a", "b"]
