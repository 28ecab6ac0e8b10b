"""Pairs of blocks of vectors are read where they are stored: what is exchanged doesn't grow with the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import epsilon_join


def plain_links(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
        if (new == comp).all():
            return {i: (int(link[i].sum()), int(comp[i])) for i in range(len(x))}
        comp = new


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 7))
    x[100:180] = x[0] + rng.normal(scale=0.2, size=(80, 7))
    x[180:220] = x[1]
    x[220:240] = x[2]
    x[220:240, 3] = np.where(np.arange(20) % 2, 0.0, -0.0)
    return np.float32(x).astype(float)


@pytest.mark.parametrize("element, tile, collide", [("float", 1500, False), ("double", 6000, False), ("double", 1 << 24, False), ("float", 3000, True)])
def test_tiles(spark, monkeypatch, element, tile, collide):
    """Whatever tiles and hashes of vectors are, links are those of a plain version, and no exchange carries pairs."""
    plans, write = [], epsilon_join.write_table

    def seen(df, name, **options):
        if name == "vector-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **options)

    monkeypatch.setattr(epsilon_join, "write_table", seen)
    monkeypatch.setattr(epsilon_join, "TILE_BYTES", tile, raising=False)
    if collide:
        monkeypatch.setattr(epsilon_join, "class_hash", lambda v: F.size(v).cast("long"))
    x = vectors()
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], f"vec_id long, embedding array<{element}>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in epsilon_join.cosine_components(df, block_rows=23).collect()}
    assert got == plain_links(x)
    assert len(plans) == 1 and "hashpartitioning" not in plans[0] and "RoundRobin" not in plans[0]
