"""Near-duplicate embeddings: p-stable Euclidean hashing finds candidates, exact cosines decide.

Normalised vectors are projected on Gaussian directions; each projection is shifted and quantised to cells of `width`,
and `cells` quantised projections together name a bucket of one table. On the unit sphere cosine 0.98 is a distance of
0.2; with width 2 a projection keeps such a pair in one cell with probability 0.92, and unrelated vectors (distance 1.4)
with 0.49. There are so many projections a table that a vector meets 0.1 unrelated ones of the largest label in it, and so
many tables that a pair at the least cosine is missed by all with 1e-6: 15 and 41 for a label of 5,000 vectors, 32 and
191 for one of 10^9, so what is shuffled grows little faster than the vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.components import components, local_components
from chartloom.llm.runtime import cut, released, ship, sized_broadcast, table

COSINE = 0.98
TABLES = 32
CELLS = 12
WIDTH = 2.0
SEED = 20_240_229
#: Larger buckets are compared in blocks of about this many vectors, each pair of blocks on its own.
BLOCK = 2_000
_BATCH = 20_000


#: How likely a pair at the least cosine may be missed, and unrelated vectors that one may meet in a table.
MISS, STRANGERS = 1e-6, 0.1


def together(distance: float, width: float) -> float:
    """How likely one projection keeps points at that distance in one cell."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def parameters(n: int, least: float = COSINE, width: float = WIDTH) -> tuple[int, int]:
    """(tables, cells) for a largest label of n vectors; the chance to miss a pair doesn't rest on n."""
    near, far = together(math.sqrt(2 - 2 * least), width), together(math.sqrt(2), width)
    cells = max(6, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
    return math.ceil(math.log(MISS) / math.log1p(-(near**cells))), cells


def buckets(vectors: np.ndarray, tables: int = TABLES, cells: int = CELLS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """The bucket of each unit vector in each table, as int32 codes."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    directions = rng.standard_normal((vectors.shape[1], tables * cells))
    shifts = rng.uniform(0, width, tables * cells)
    mixers = rng.integers(1, 1 << 62, (tables, cells), dtype=np.int64) | 1
    cell = np.floor((vectors @ directions + shifts) / width).astype(np.int64).reshape(len(vectors), tables, cells)
    mixed = (cell * mixers).sum(2).view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(rows: pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # squares neither overflow nor vanish
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _pairs(unit: np.ndarray, codes: np.ndarray, at: int, own: np.ndarray, least: float):
    """Linked pairs among one bucket's rows, counted here only if no earlier table or shared bucket holds them; rows of the same block of a split bucket meet in several cells, `own` says in which they count."""
    for x in range(0, len(unit), 512):
        i, j = np.nonzero(unit[x : x + 512] @ unit.T >= least)
        i += x
        keep = (i < j) & own[i, j] if own.ndim == 2 else i < j
        i, j = i[keep], j[keep]
        for y in range(0, len(i), 1 << 18):
            p, q = i[y : y + (1 << 18)], j[y : y + (1 << 18)]
            first = ~(codes[p, :at] == codes[q, :at]).any(1) if at else np.ones(len(p), bool)
            yield p[first], q[first]


def _compare(group: pa.Table, least: float) -> pa.RecordBatch:
    """For the sorted rows of whole cells: star links among their classes and, for each class, the rows it links to."""
    col = {n: group.column(n).to_numpy() for n in ("t", "bi", "bj", "own", "rows")}
    same = np.ones(len(group), bool)
    if len(group):
        same[0] = False
        for n in ("label", "dim", "t", "bucket", "bi", "bj"):
            v = group.column(n).to_numpy()
            same[1:] &= v[1:] == v[:-1]
    starts = np.flatnonzero(~same)
    ends = np.r_[starts[1:], len(group)] if len(starts) else starts
    vec, h, counts = group.column("vec").to_numpy(), group.column("h").to_numpy(), np.zeros(len(group), np.int64)
    a, b = [], []
    big = ends - starts > 1
    for s, e in zip(starts[big].tolist(), ends[big].tolist()):
        part = group.slice(s, e - s)
        arrays = part.column("v").combine_chunks()
        if len({len(x) for x in arrays}) > 1:
            raise ValueError("a bucket holds vectors of different length")
        unit = _unit(arrays)
        codes = part.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
        own = np.zeros(0)
        if col["bi"][s] != col["bj"][s]:
            o = col["own"][s:e]
            own = o[:, None] != o[None, :]
        for p, q in _pairs(unit, codes, int(col["t"][s]), own, least):
            np.add.at(counts, p + s, col["rows"][q + s])
            np.add.at(counts, q + s, col["rows"][p + s])
            a.append(p + s)
            b.append(q + s)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    if len(a):
        label = local_components(len(group), a, b)
    else:
        label = np.arange(len(group))
    at = np.flatnonzero((label != np.arange(len(group))) | (counts > 0))
    return pa.RecordBatch.from_arrays([pa.array(vec[at]), pa.array(h[at]), pa.array(vec[label[at]]), pa.array(h[label[at]]), pa.array(counts[at])], names=["vec_a", "h_a", "vec_b", "h_b", "n"])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, tables: int | None = None, cells: int | None = None, width: float = WIDTH) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row given.

    Two rows link if their labels are equal and not null and their vectors' cosine, in double precision, is at least
    `least`. Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do rows
    with a null label or id, or vectors of different length; such rows have n_links 0 and their own id as component. A
    null id has a null component and is kept. Rows of equal label and vector are one class: it is compared once and its
    rows count in n_links of all that it links to, among themselves too (repeated rows included). Several rows with one
    id are rows of their own. An empty table gives no rows; columns other than the three named are ignored. Tables and cells
    that aren't given follow from the counted size of the largest label.
    """
    spark = rows.sparkSession
    ship(spark)
    data = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    data = data.withColumn("h", F.when(fit, F.xxhash64("label", F.transform("v", lambda x: x + 0.0))))
    classes = cut(data.where("h is not null").groupBy("label", "v", "h").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("rows")))

    if tables is None or cells is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        fit_tables, fit_cells = parameters(most, least, width)
        tables, cells = tables or fit_tables, cells or fit_cells

    def hashed(batches):
        for batch in released(batches):
            lengths = np.array([len(x) for x in batch.column("v")], np.int64)
            for n in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == n)))
                codes = buckets(_unit(part.column("v")), tables, cells, width)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "vec", "h", "rows", "v")), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int32())), pa.array(np.full(part.num_rows, n))], names=["label", "vec", "h", "rows", "v", "codes", "dim"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    coded = cut(classes.select("label", "vec", "h", "rows", "v").mapInArrow(hashed, f"label {kinds['label']}, vec {kinds['vec']}, h long, rows long, v array<double>, codes array<int>, dim long"))
    spots = coded.select("label", "dim", "h", F.posexplode("codes").alias("t", "bucket"))
    # a bucket's rows are counted without their vectors; only those that share one are dealt out with them
    sizes = spots.groupBy("label", "dim", "t", "bucket").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    sizes = cut(sizes.withColumnsRenamed({"label": "l", "dim": "d", "t": "tt", "bucket": "bb"}))
    shared = spots.join(sized_broadcast(sizes, sizes.count(), 100_000), F.expr("label = l and dim = d and t = tt and bucket = bb")).select("h", "t", "bucket", "blocks")
    member = coded.select("label", "dim", "vec", "h", "rows", "v", "codes").join(shared, "h")
    own = F.pmod(F.col("h"), F.col("blocks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("bi"), F.greatest("own", j).alias("bj")))
    cells_ = member.withColumn("own", own).withColumn("cell", F.explode(cell)).select("label", "dim", "t", "bucket", "cell.bi", "cell.bj", "own", "vec", "h", "rows", "v", "codes")
    keys = ["label", "dim", "t", "bucket", "bi", "bj"]

    def compare(batches):
        held, n = [], 0
        for batch in released(batches):
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= _BATCH:
                group = pa.Table.from_batches(held)
                last = [group.column(k)[n - 1] for k in keys]
                end = n
                while end and [group.column(k)[end - 1] for k in keys] == last:
                    end -= 1
                if end:
                    yield _compare(group.slice(0, end), least)
                    held, n = group.slice(end).to_batches(), n - end
        if held:
            yield _compare(pa.Table.from_batches(held), least)

    found = cut(cells_.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, f"vec_a {kinds['vec']}, h_a long, vec_b {kinds['vec']}, h_b long, n long"))
    node = lambda x: F.struct(F.col(f"vec_{x}").alias("vec"), F.col(f"h_{x}").alias("h"))
    roots = components(found.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.h").alias("h"), F.col("root.vec").alias("component_id"))
    counts = found.groupBy(F.col("h_a").alias("h")).agg(F.sum("n").alias("n"))
    known = classes.select("h", "vec", "rows").join(counts, "h", "left").join(roots, "h", "left").select("h", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component_id", "vec").alias("component_id"))
    out = data.select("vec_id", "h").join(known, "h", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links, component and whether they stay; nulls, ties, repeated rows and empty tables as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
