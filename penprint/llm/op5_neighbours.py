"""Operator 5: approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by HASHES random projections cut into cells. A query visits its own bucket and
neighbouring ones in the order of their estimated chance of holding a neighbour, until the chances add up to SUCCESS; what
the tables find is ranked by exact distance. Queries with fewer than k neighbours, or whose farthest lies beyond
the radius that the cells were made for, look again in rounds of wider cells; the last few are compared with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mix, read

#: Neighbours of a query, tables, projections of a table, a cell's width in distances of the farthest neighbour wanted, and
#: the estimated chance, table by table, at which probing stops.
NEIGHBOURS = 10
TABLES = 3
HASHES = 6
WIDTH = 2.2
SUCCESS = 0.65
SEED = 5

#: The registered query asks for the neighbours of every row whose id this divides.
QUERY_EVERY = 20

#: Rows from which the distance of neighbours is estimated, vectors that one shard of a table holds, and queries that one
#: block of them holds.
RADIUS_ROWS = 256
SHARD_ROWS = 8192
BLOCK_ROWS = 1024

#: Rows that are compared with all rows at one time, without another round once no more are left, and rounds at most before that.
EXACT_ROWS = 1024
ROUNDS = 8


def radius(vectors: DataFrame, dim: int, k: int, queries: DataFrame) -> float:
    """The distance within which 9 of 10 queries have their k nearest: of RADIUS_ROWS, each against all vectors."""
    import numpy as np

    some = queries.orderBy(F.md5(F.col("id").cast("string")), "id").limit(RADIUS_ROWS).collect()
    if not some:
        return 1.0
    ids, q = np.array([r["id"] for r in some]), np.array([r["v"] for r in some], np.float32)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best = np.full((len(q), k), np.inf, np.float32)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float32)
            d = (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T
            d[ids[:, None] == batch.column(0).to_numpy()] = np.inf
            best = np.partition(np.concatenate([best, d], 1), k - 1, 1)[:, :k]
        rows, cols = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(best[rows, cols])], ["q", "d"])

    place = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    near = vectors.mapInArrow(run, "q int, d float").withColumn("k", place).where(F.col("k") <= k).groupBy("q").agg(F.max("d").alias("d"))
    found = [r["d"] for r in near.collect()]
    return float(np.sqrt(max(np.quantile(found, 0.9), 1e-12))) if found else 1.0


def projections(dim: int, tables: int, hashes: int, width: float, seed: int):
    import numpy as np

    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables, dim, hashes)), rng.uniform(0, width, (tables, hashes))


def bucket_of(cells, table: int):
    """One number for the cells of each row."""
    import numpy as np

    out = np.full(cells.shape[:-1], table + 1, np.uint64)
    for i in range(cells.shape[-1]):
        out = mix(out * np.uint64(31) + cells[..., i].astype(np.int64).view(np.uint64))
    return out


def probes(place, width: float, r: float, success: float, steps):
    """Perturbations to visit, best first: indices into steps and how many of them, by row.

    place: each row's places in its cells, in cells. The chance that a neighbour at distance r lies in a cell that is d steps
    away is that of a normal variable; a bucket's chance is the product over its projections.
    """
    import numpy as np

    cuts = np.stack([-1 - place, -place, 1 - place, 2 - place], -1) * (width / r)
    below = _normal(cuts)
    chance = np.log(np.maximum(np.diff(below, axis=-1), 1e-12))  # of -1, 0 and +1 steps
    total = np.zeros((len(place), len(steps)))
    for i in range(steps.shape[1]):
        total += chance[:, i, steps[:, i] + 1]
    order = np.argsort(-total, 1, kind="stable")
    sums = np.cumsum(np.exp(np.take_along_axis(total, order, 1)), 1)
    return order, np.minimum((sums < success).sum(1) + 1, len(steps))


def _normal(x):
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    import numpy as np

    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def neighbours(
    vectors: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, success: float = SUCCESS, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, every: int = 1,
) -> DataFrame:
    """(id, neighbour, distance, rank): up to k other rows near each query, by Euclidean distance, rank from 1; ties by id.

    Queries are the rows whose id `every` divides, all rows unless told otherwise; neighbours are looked for among all rows.
    Rows whose id or vector is null, that hold a null or NaN, or whose length isn't that of most vectors (the greater of
    equally frequent ones) are neither queries nor neighbours. Repeated ids with equal vectors count once; of an id with several
    vectors the greatest counts. Equal vectors of different ids are neighbours at distance 0. Other columns are ignored. An
    empty table gives no rows. The rounds run when this is called.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x))")
    sizes = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None or not sizes["n"]:
        return spark.createDataFrame([], f"{id_col} long, neighbour long, distance double, rank int")
    dim = sizes["n"]
    clean = clean.where(F.size("v") == dim).groupBy("id").agg(F.max("v").alias("v"))
    scratch = Scratch(spark, "neighbours")
    clean = scratch.write(clean, "vectors")
    total = clean.count()
    rest, rounds = clean.where(F.col("id") % every == 0), []
    left, r = rest.count(), radius(clean, dim, k, rest)
    while left and (not rounds or left > EXACT_ROWS and len(rounds) < ROUNDS):
        shards = max(1, -(-total // shard_rows))
        best = nearest(search(clean, rest, dim, r, k, tables, hashes, width, success, seed, shards, shard_rows), k)
        rounds.append(scratch.write(best, f"round{len(rounds)}"))
        answered = rounds[-1].groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).where((F.col("n") >= min(k, total - 1)) & (F.col("d") <= r * r))
        rest = scratch.write(rest.join(answered.select("id"), "id", "left_anti"), f"rest{len(rounds)}")
        left = rest.count()
        if left > EXACT_ROWS:
            r = max(2 * r, radius(clean, dim, k, rest))
    if left:
        rounds += exact(clean, rest, dim, k, scratch)
    if not rounds:
        return spark.createDataFrame([], f"{id_col} long, neighbour long, distance double, rank int")
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return nearest(found, k).select(F.col("id").alias(id_col), "neighbour", F.sqrt("d").alias("distance"), "rank")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, d, rank): the k nearest of each query among what was found, each neighbour once."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbour"))
    best = found.groupBy("id", "neighbour").agg(F.min("d").alias("d")).withColumn("rank", place)
    return best.where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, dim: int, k: int, scratch: Scratch) -> list[DataFrame]:
    """(id, neighbour, d, rank) of each query against all vectors, a table for EXACT_ROWS queries."""
    import itertools

    import numpy as np

    out, rows = [], queries.select("id", "v").toLocalIterator()
    while some := list(itertools.islice(rows, EXACT_ROWS)):
        ids, q = np.array([x["id"] for x in some]), np.array([x["v"] for x in some], np.float32)

        def run(batches: Iterator, ids=ids, q=q) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK_ROWS):
                    batch = whole.slice(at, BLOCK_ROWS)
                    known, y = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float32)
                    table = np.zeros(1, np.uint64), np.array([0, len(known)]), known, y, (y**2).sum(1)
                    got = visited(ids, q, np.arange(len(ids)), np.zeros(len(ids), np.uint64), table, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["id", "neighbour", "d"])

        best = nearest(vectors.select("id", "v").mapInArrow(run, "id long, neighbour long, d double"), k)
        out.append(scratch.write(best, f"exact{len(out)}"))
    return out


def search(vectors: DataFrame, queries: DataFrame, dim: int, r: float, k: int, tables: int, hashes: int, width: float, success: float, seed: int, shards: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, neighbour, d): what each query finds among the vectors in cells of `width` times r; d: squared distance.

    A table's buckets fall into `shards` parts by their hash. A part with more than a shard's rows, such as that of a hot bucket, is
    split by id into pieces; its queries go to each piece.
    """
    import itertools

    import numpy as np

    w = width * r
    a, b = projections(dim, tables, hashes, w, seed)
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=hashes)))
    part_of = lambda bucket, t: t * shards + (bucket % np.uint64(shards)).astype(np.int64)

    def cells_of(batch):
        """ids, vectors, and for each table the places in cells and the cells."""
        x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
        places = [(x @ a[t] + b[t]) / w for t in range(tables)]
        return batch.column(0).to_numpy(), x.astype(np.float32), [(p - np.floor(p), np.floor(p).astype(np.int64)) for p in places]

    def own(batches: Iterator, whole: bool) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, x, cells = cells_of(batch)
            bucket = [bucket_of(c, t) for t, (_, c) in enumerate(cells)]
            part = pa.array(np.concatenate([part_of(h, t) for t, h in enumerate(bucket)]))
            if not whole:
                yield pa.RecordBatch.from_arrays([part], ["part"])
                continue
            data = pa.array([y.tobytes() for y in x], pa.binary())
            yield pa.RecordBatch.from_arrays([part, pa.array(np.tile(ids, tables)), pa.array(np.concatenate(bucket).view(np.int64)), pa.concat_arrays([data] * tables)], ["part", "id", "bucket", "v"])

    def ask(batches: Iterator) -> Iterator:
        """A row for each query and part: the buckets that it visits there."""
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                ids, x, cells = cells_of(whole.slice(at, BLOCK_ROWS))
                for t, (place, cell) in enumerate(cells):
                    order, n = probes(place, w, r, success, steps)
                    who = np.repeat(np.arange(len(ids)), n)
                    bucket = bucket_of(cell[who] + steps[order[np.arange(order.shape[1]) < n[:, None]]], t)
                    part = part_of(bucket, t)
                    by = np.lexsort((part, who))
                    who, part, bucket = who[by], part[by], bucket[by]
                    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (part[1:] != part[:-1])])) if len(who) else np.zeros(0, int)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(who)).astype(np.int32)), pa.array(bucket.view(np.int64)))
                    data = pa.array([y.tobytes() for y in x], pa.binary()).take(pa.array(who[first]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(ids[who[first]]), lists, data], ["part", "id", "buckets", "v"])

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        piece, held, table = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for i, j in zip(edge, [*edge[1:], len(keys)]):
                if tuple(keys[i, :2]) != piece:
                    piece, held, table = tuple(keys[i, :2]), [], None
                some = batch.slice(i, j - i)
                ids, x = some.column(3).to_numpy(), np.frombuffer(b"".join(some.column(5).to_pylist()), np.float32).reshape(-1, dim)
                buckets = some.column(4).flatten().to_numpy().view(np.uint64)
                if not keys[i, 2]:
                    held.append((buckets, ids, x))
                    continue
                if table is None and held:
                    known = [np.concatenate(c) for c in zip(*held)]
                    by = np.lexsort((known[1], known[0]))
                    known = [c[by] for c in known]
                    names, first = np.unique(known[0], return_index=True)
                    table, held = (names, np.append(first, len(by)), known[1], known[2], (known[2] ** 2).sum(1)), []
                if table is None:
                    continue
                n = some.column(4).value_lengths().to_numpy()
                ends = np.cumsum(n)
                for at in range(0, len(ids), BLOCK_ROWS):
                    mine = slice(at, at + BLOCK_ROWS)
                    row = np.repeat(np.arange(len(ids[mine])), n[mine])
                    got = visited(ids[mine], x[mine], row, buckets[ends[at] - n[at] : ends[mine][-1]], table, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["id", "neighbour", "d"])

    schema = "part long, id long, bucket long, v binary"
    sizes = vectors.select("id", "v").mapInArrow(lambda x: own(x, False), "part long").groupBy("part").count().where(F.col("count") > shard_rows)
    sizes = sizes.select("part", F.expr(f"cast((count - 1) div {shard_rows} as int)").alias("more"))
    index = vectors.select("id", "v").mapInArrow(lambda x: own(x, True), schema).join(sizes, "part", "left")
    index = index.select("part", F.expr("pmod(xxhash64(id), coalesce(more, 0) + 1)").cast("int").alias("piece"), F.lit(0).alias("kind"), "id", F.array("bucket").alias("buckets"), "v")
    asked = queries.select("id", "v").mapInArrow(ask, "part long, id long, buckets array<long>, v binary").join(sizes, "part", "left")
    asked = asked.select("part", F.explode(F.expr("sequence(0, coalesce(more, 0))")).alias("piece"), F.lit(1).alias("kind"), "id", "buckets", "v")
    sent = index.unionByName(asked).repartition("part", "piece").sortWithinPartitions("part", "piece", "kind")
    return sent.mapInArrow(find, "id long, neighbour long, d double")


def visited(ids, x, row, bucket, table, k: int):
    """The k nearest of each query among the buckets that it visits in this shard: query id, id, exact squared distance."""
    import numpy as np

    names, edge, known, y, norm = table
    best = np.full((len(ids), k), np.inf, np.float32)
    who = np.full((len(ids), k), -1, np.int64)
    at = np.searchsorted(names, bucket)
    at[at == len(names)] = 0
    hit = np.flatnonzero(names[at] == bucket)
    hit = hit[np.argsort(at[hit], kind="stable")]
    groups = np.flatnonzero(np.concatenate([[True], at[hit][1:] != at[hit][:-1]])) if len(hit) else []
    for s, e in zip(groups, [*groups[1:], len(hit)]):
        q = row[hit[s:e]]
        i = at[hit[s]]
        span = slice(edge[i], edge[i + 1])
        d = norm[span] - 2 * (x[q] @ y[span].T)  # the query's own norm doesn't change the order
        d[ids[q][:, None] == known[span]] = np.inf
        some = d.min(1) < best[q, -1]
        q, d = q[some], d[some]
        if not len(q):
            continue
        both = np.concatenate([best[q], d], 1)
        names_ = np.concatenate([who[q], np.broadcast_to(np.arange(span.start, span.stop), d.shape)], 1)
        pick = np.argpartition(both, k - 1, 1)[:, :k]
        both, names_ = np.take_along_axis(both, pick, 1), np.take_along_axis(names_, pick, 1)
        by = np.argsort(both, 1, kind="stable")
        best[q], who[q] = np.take_along_axis(both, by, 1), np.take_along_axis(names_, by, 1)
    q, c = np.nonzero(np.isfinite(best))
    other = who[q, c]
    exact = ((x[q].astype(np.float64) - y[other].astype(np.float64)) ** 2).sum(1)
    return ids[q], known[other], exact


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by QUERY_EVERY, against all rows."""
    return neighbours(read(spark, sf_dir, "embeddings"), every=QUERY_EVERY)


QUERIES = {"op5_neighbours": op5_neighbours}
SQL: dict[str, str] = {}
