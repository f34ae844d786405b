"""Embedding near-dedup by an exact metric range join: pivots partition the vectors, the triangle inequality says which vectors
near a boundary are copied to other cells, and cells are joined independently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fits, join_hot, materialize, ship, small_side, table
from larkspur.llm.components import connected

ship(__name__)

COSINE = 0.9
#: Vectors of a cell, on average, for up to PIVOTS pivots; beyond, both grow with the square root of the vectors.
CELL, PIVOTS = 2048, 512
#: Bytes of pivots at most, which the driver sees and every task gets.
PIVOT_BYTES = 16 << 20
#: Pivots nearer to each other than this share no plane, as it would be lost in rounding.
LEAST_GAP = 1e-3
#: Numbers that the home vectors of one unit of work hold, and its visitors twice that; larger cells are dealt over several units.
BLOCK = 1 << 20
#: Added to the radius, far above the rounding errors of distances between unit vectors in double precision.
SLACK = 1e-6


def scaled(values: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that squares neither overflow nor vanish."""
    return np.ldexp(values, -np.frexp(np.abs(values).max(1, keepdims=True))[1])


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = scaled(values)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, n, v: one row for each distinct direct value of a usable vector; vec_id, rep: every row)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>")  # floats are kept as floats, which is exact
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.transform(v, lambda x: F.when(x == 0, F.lit(0.0).cast("float" if kind == "float" else "double")).otherwise(x))).alias("v"))
    some = rows.where(F.col("v").isNotNull())
    key = [F.xxhash64("v"), F.xxhash64(F.lit(5), "v")]
    reps = some.select(*[k.alias(f"k{i}") for i, k in enumerate(key)], "vec_id", "v").groupBy("k0", "k1").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nameless = F.shiftrightunsigned("k0", 2).bitwiseOR(F.lit(1 << 62))  # larger than ids in use
    reps = materialize(reps.withColumn("rep", F.coalesce("rep", nameless)))
    members = rows.select("vec_id", F.when(F.col("v").isNotNull(), key[0]).alias("k0"), F.when(F.col("v").isNotNull(), key[1]).alias("k1"))
    return reps, members


def pivot_count(total: int, width: int) -> int:
    """Pivots for ``total`` vectors. Each vector is held against all pivots and against its cell; with both growing as the
    square root of the vectors, comparisons grow with their power 1.5."""
    count = total // CELL
    if count > PIVOTS:
        count = int((PIVOTS * count) ** 0.5)
    return max(1, min(count, PIVOT_BYTES // (8 * width)))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def reached(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the nearest pivot of each unit vector, and whether each cell is within its reach.

    If x lies in the cell of p and y within ``radius`` of x, then d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2 r for
    y's own pivot q; as these are points of a Euclidean space, y also lies within r of the plane between p and q.
    """
    d = distances(x, pivots)
    own = d.argmin(1)
    near = d[np.arange(len(x)), own]
    owners, at = np.unique(own, return_inverse=True)
    gap = distances(pivots[owners], pivots)[at]
    plane = (d * d - (near * near)[:, None]) / (2 * np.maximum(gap, LEAST_GAP))
    inside = (d <= near[:, None] + 2 * radius + SLACK) & ((plane <= radius + SLACK) | (gap < LEAST_GAP))
    inside[np.arange(len(x)), own] = True
    return own, inside


def pieces(batch: pa.RecordBatch, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch``, of fewer rows where there are many pivots, so that a table of distances takes 8 MB."""
    step = max(1, min(1024, (1 << 20) // len(pivots)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def vectors_of(b: pa.RecordBatch) -> np.ndarray:
    v = b.column("v")
    return unit_rows(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64))


def cell_sizes(reps: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """cell, homes, all: how many vectors each cell holds and how many reach it; no vector is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, every = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
        for batch in batches:
            for b in pieces(batch, pivots):
                own, inside = reached(vectors_of(b), pivots, radius)
                homes += np.bincount(own, minlength=len(pivots))
                every += inside.sum(0)
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(homes[some]), pa.array(every[some])], ["cell", "homes", "all"])

    return reps.select("v").mapInArrow(run, "cell int, homes long, all long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("all").alias("all"))


def dealt(reps: DataFrame, pivots: np.ndarray, radius: float, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """unit, role, rep, n, v: each vector in the units of its own cell (role 0, its block of homes against each block of those
    that reach the cell), and of every cell within its reach (role 1, its block of these against each block of homes)."""
    kind = reps.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, w = (np.array([blocks[c][k] for c in range(len(pivots))], np.int64) for k in (0, 1))
        first = np.cumsum(h * w) - h * w  # units of a cell follow those of the cells before
        for batch in batches:
            for b in pieces(batch, pivots):
                own, inside = reached(vectors_of(b), pivots, radius)
                key = b.column("rep").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                row, cell = inside.nonzero()
                rows, units, roles = [], [], []
                for role, r, c, times in ((0, np.arange(len(own)), own, w), (1, row, cell, h)):
                    k = np.repeat(np.arange(len(r)), times[c])
                    other = np.arange(len(k)) - np.repeat(np.cumsum(times[c]) - times[c], times[c])
                    r, c = r[k], c[k]
                    mine = (key[r] % (h if role == 0 else w)[c].astype(np.uint64)).astype(np.int64)
                    rows.append(r)
                    units.append(first[c] + (mine * w[c] + other if role == 0 else other * w[c] + mine))
                    roles.append(np.full(len(r), role, np.int8))
                rows, units, roles = np.concatenate(rows), np.concatenate(units), np.concatenate(roles)
                for k in range(0, len(rows), 8192):
                    taken = b.take(pa.array(rows[k : k + 8192]))
                    yield pa.RecordBatch.from_arrays([pa.array(units[k : k + 8192]), pa.array(roles[k : k + 8192]), taken.column("rep"), taken.column("n"), taken.column("v")], ["unit", "role", "rep", "n", "v"])

    return reps.select("rep", "n", "v").mapInArrow(run, f"unit long, role byte, rep long, n long, v {kind}")


def join_unit(part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of one unit: for each home vector the number of rows within reach here, and links that join what is connected here."""
    home = part["role"].to_numpy() == 0
    ids, n = part["rep"].to_numpy(), part["n"].to_numpy()
    raw = scaled(np.stack(part["v"].to_numpy()).astype(np.float64))
    x = unit_rows(raw)
    a, b = np.flatnonzero(home), np.flatnonzero(~home)
    links, other, parent = np.zeros(len(a), np.int64), [], {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rough = x.astype(np.float32)
    for at in range(0, len(a), 256):
        i, j = (rough[a[at : at + 256]] @ rough[b].T >= np.float32(cosine - 1e-4)).nonzero()
        i, j = a[at + i], b[j]
        u, v = raw[i], raw[j]
        exact = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)) >= cosine
        i, j = i[exact & (ids[i] != ids[j])], j[exact & (ids[i] != ids[j])]
        np.add.at(links, np.searchsorted(a, i), n[j])
        for s, t in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
            if (p := find(s)) != (q := find(t)):
                parent[max(p, q)] = min(p, q)
                other.append((s, t))
    some = links > 0
    rows = pd.DataFrame({"rep": ids[a[some]], "links": links[some], "to": -1})
    return pd.concat([rows, pd.DataFrame({"rep": [s for s, _ in other], "links": 0, "to": [t for _, t in other]})]).astype({"rep": "int64", "links": "int64", "to": "int64"})


FOUND = "rep long, links long, to long"


def joined(reps: DataFrame, width: int, total: int, cosine: float) -> DataFrame:
    """rep, links, to: what the units find among the ``total`` class representatives of one ``width``."""
    radius = float(np.sqrt(2 - 2 * cosine))
    top = reps.select("v").orderBy(F.xxhash64(F.lit(17), "v"), "rep").limit(pivot_count(total, width)).collect()
    top = unit_rows(np.array([r["v"] for r in top], np.float64))
    sizes = {r["cell"]: (r["homes"], r["all"]) for r in cell_sizes(reps, top, radius).collect()}
    # At most as many numbers as pivots: how many blocks each cell's home rows and those that reach it are dealt into.
    blocks = {c: tuple(max(1, -(-n * width // size)) for n, size in zip(sizes.get(c, (0, 0)), (BLOCK, 2 * BLOCK), strict=True)) for c in range(len(top))}
    return dealt(reps, top, radius, blocks).groupBy("unit").applyInPandas(lambda part: join_unit(part, cosine), FOUND)


def joined_short(reps: DataFrame, widths: DataFrame, cosine: float) -> DataFrame:
    """rep, links, to: the same of all lengths in ``widths`` (width, count), which have too few vectors for pivots: each length
    is one cell, dealt into blocks as any other, and all of them are one plan."""
    rows = reps.withColumn("width", F.size("v")).join(small_side(widths), "width")
    h, w = (F.greatest(F.lit(1), F.ceil(F.col("count") * F.col("width") / size)).cast("long") for size in (BLOCK, 2 * BLOCK))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(23), "rep"), 1)
    home = F.transform(F.sequence(F.lit(0).cast("long"), w - 1), lambda j: F.struct((key % h * w + j).alias("unit"), F.lit(0).cast("byte").alias("role")))
    other = F.transform(F.sequence(F.lit(0).cast("long"), h - 1), lambda j: F.struct((j * w + key % w).alias("unit"), F.lit(1).cast("byte").alias("role")))
    units = rows.select("width", "rep", "n", "v", F.explode(F.concat(home, other)).alias("u")).select("width", "u.unit", "u.role", "rep", "n", "v")
    return units.groupBy("width", "unit").applyInPandas(lambda part: join_unit(part, cosine), FOUND)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding; other columns are not read).

    Vectors link if their cosine, in double precision, is ``cosine`` or more. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different lengths with each other. Lengths of fewer
    than two cells of vectors are joined together in one plan, the others, of which there are few, one by one. Equal vectors are one class that is joined once; repeated ids count as rows. Rows without vec_id are
    compared too, have a component only through others, and are kept if they have none. An empty table gives no rows.
    """
    reps, members = classes(vectors)
    widths = materialize(reps.groupBy(F.size("v").alias("width")).count())
    found = joined_short(reps, widths.where(F.col("count") < 2 * CELL), cosine)
    for r in widths.where(F.col("count") >= 2 * CELL).collect():  # one row for 2 * CELL vectors at most
        found = found.union(joined(reps.where(F.size("v") == r["width"]), r["width"], r["count"], cosine))
    found = materialize(found)
    counts = found.where("to < 0 and links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected(found.where("links = 0").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    of = reps.select("k0", "k1", "rep", "n").join(counts, "rep", "left").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of = materialize(of.select("k0", "k1", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = members.join(F.broadcast(of.drop("n")), ["k0", "k1"], "left") if fits(of) else join_hot(members, of, ["k0", "k1"], "left")
    component = F.coalesce(F.when(F.col("component_id") < (1 << 62), F.col("component_id")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op4_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
with recursive v as (select vec_id, case when embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0 then embedding::double[] end as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {COSINE}),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v join c on v.vec_id = c.a left join n on v.vec_id = n.a
"""
