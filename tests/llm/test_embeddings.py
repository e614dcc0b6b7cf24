import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, h string"


def brute(rows):
    """Links and components by double-precision cosines over all pairs."""
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.linalg.norm(x)

    units = [unit(r[1]) if r[0] is not None and r[2] is not None else None for r in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(find(i))) for i in range(n)), key=str)


def planted():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(25):
            center = rng.standard_normal(16)
            for k in range(rng.integers(1, 7)):
                x = center + rng.standard_normal(16) * 0.18 * (k > 0)
                rows.append((n, [float(np.float32(v)) for v in x * rng.choice([1, 3])], label, "x"))
                n += 1
    rows += [(n, rows[0][1], 1, None), (n + 1, rows[0][1], 1, "y"), (n + 2, rows[0][1], 2, "y"), (n + 3, rows[0][1], None, "y"), (n + 4, None, 1, "y"), (n + 5, [0.0] * 16, 1, "y"), (n + 6, [float("nan")] + [1.0] * 15, 1, "y"), (n + 7, [float("inf")] + [1.0] * 15, 1, "y"), (n + 8, [None] + [1.0] * 15, 1, "y"), (n + 9, [], 1, "y"), (None, rows[0][1], 1, "y"), (n + 10, [1.0] * 3, 1, "y"), (n + 11, [1.0] * 3, 1, "y"), (n + 11, [1.0] * 3, 1, "y")]
    return rows


@pytest.mark.parametrize("block", [embeddings.BLOCK, 2])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = planted()
    out = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert embeddings.near_duplicates(df).count() == 0
    assert embeddings.near_duplicates(df.withColumn("v", F.lit(1))).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_recall_at_the_limit():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    met = (embeddings.buckets(a) == embeddings.buckets(0.98 * a + np.sqrt(1 - 0.98**2) * b)).any(1)
    assert met.mean() > 0.9995


def test_parameters_keep_recall_at_every_size():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    for n in (1, 500, 50_000, 10**9):
        tables, cells = embeddings.parameters(n)
        assert (embeddings.buckets(a, tables, cells) == embeddings.buckets(near, tables, cells)).any(1).mean() > 0.999
    assert embeddings.parameters(5000) == (41, 15) and abs(embeddings.together(0.2, 2.0) - 0.9202) < 1e-3


@pytest.mark.parametrize("tables,cells", [(60, 20), (20, 6)])
def test_results_do_not_rest_on_the_parameters(spark, tables, cells):
    df = spark.createDataFrame(planted(), SCHEMA)
    key = lambda r: str(tuple(r))
    assert sorted(embeddings.near_duplicates(df).collect(), key=key) == sorted(embeddings.near_duplicates(df, tables=tables, cells=cells).collect(), key=key)


def test_equals_brute_force_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "sized_broadcast", lambda df, rows, most: df)
    rows = planted()
    out = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute(rows)
