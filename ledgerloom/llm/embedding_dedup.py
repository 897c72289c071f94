"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label by the concatenated signs of random projections (around the label's mean, so that
signs are fair however alike its vectors are) and compares every vector with a bounded window of those that follow. Verified pairs leave a
task as stars, never one by one, and unite to components across passes. An exact check follows for every label, whatever its size: blocks of it
meet each other in the order of those components, strips that lie too far apart to hold a link are left out, all other pairs are compared, and links
are counted. Equal vectors form a class that takes part as one, with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, join_by_size, spread

COSINE = 0.93
#: A vector is compared with WINDOW to 2 * WINDOW neighbours in each of PASSES passes; keys have BITS signs.
WINDOW, PASSES, BITS = 512, 8, 48
#: Vectors of a label that recall() holds against all others of it.
SAMPLE = 512
#: Of a switch by size that is gone: tests still set them, no code reads them.
SURE, ROUNDS = 16_384, 4
#: A label has BLOCKS blocks, fewer if they held less than BLOCK vectors, and more if they held over NUMBERS components.
BLOCK, BLOCKS, NUMBERS = 256, 8, 1 << 21
#: Pairs of vectors that are compared at once, vectors that are ruled out at once, and vectors of a component that are not ruled out together with others.
STRIP, PIECE, LEAST = 1 << 20, 128, 16


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All components one after the other, and where each vector starts (and the last ends)."""
    starts = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), starts - starts[0]


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (vec_id, label, v) scaled to unit length; those that can't link keep their vec_id alone."""
    for batch in batches:
        fit = pc.and_(pc.is_valid(batch.column("label")), pc.fill_null(pc.greater(pc.list_value_length(batch.column("v")), 0), False))
        able, unable = batch.filter(fit), batch.filter(pc.invert(fit))
        flat, starts = _flat(able.column("v"))
        ids, labels, size = able.column("vec_id"), able.column("label"), np.diff(starts)
        linked = np.zeros(able.num_rows, bool)
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            x = flat[starts[own][:, None] + np.arange(d)]  # null components read as NaN
            most = np.abs(x).max(axis=1)
            fit = np.isfinite(most) & (most > 0)
            x = x[fit] / most[fit, None]  # first, so that no square overflows
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            linked[own[fit]] = True
            rows = pa.array(own[fit])
            space = [f"{name}/{d}" for name in labels.take(rows).to_pylist()]
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(d)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(space, pa.string()), v], ["vec_id", "space", "v"])
        single = pa.concat_arrays([unable.column("vec_id"), ids.filter(pa.array(~linked))])
        yield pa.RecordBatch.from_arrays([single, pa.nulls(len(single), pa.string()), pa.nulls(len(single), pa.list_(pa.float64()))], ["vec_id", "space", "v"])


def unit(vectors: DataFrame) -> DataFrame:
    """Every row's vec_id, space (label and length) and v, of unit length in double; space and v are null where the vector can't link."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(_scaled, "vec_id long, space string, v array<double>")


def _near(x: np.ndarray, y: np.ndarray, cosine: float, rough: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y whose product is ``cosine`` at least; ``rough`` are both in single precision.

    Single precision settles what lies further from the limit than it can err. The rest is added up in double, component by component, so a pair is
    judged alike in any block.
    """
    a, b = rough or (x.astype(np.float32), y.astype(np.float32))
    doubt = (x.shape[1] + 8) * 2.0**-23
    product = a @ b.T
    close = product >= np.float32(cosine - doubt)
    if not close.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.divmod(np.flatnonzero(close), len(y))
    sure = product[i, j] >= np.float32(cosine + doubt)
    rest = np.flatnonzero(~sure)
    for at in range(0, len(rest), 1 << 14):
        own = rest[at : at + (1 << 14)]
        sure[own] = (x[i[own]] * y[j[own]]).sum(axis=1) >= cosine
    return i[sure], j[sure]


def _strips(roots: np.ndarray, rows: int) -> np.ndarray:
    """Where strips of sorted roots start, and the end: a root of LEAST rows or more has strips of its own, none is longer than ``rows``."""
    runs = np.flatnonzero(np.diff(roots, prepend=roots[:1] - 1))
    size = np.diff(runs, append=len(roots))
    own = size >= LEAST
    return np.unique(np.concatenate([np.arange(0, len(roots), rows), runs[own], runs[own] + size[own], [len(roots)]]))


def _balls(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of each strip."""
    size = np.diff(starts)
    centre = np.add.reduceat(x, starts[:-1]) / size[:, None]
    apart = x - np.repeat(centre, size, axis=0)
    return centre, np.sqrt(np.maximum.reduceat((apart * apart).sum(axis=1), starts[:-1]))


def _compare(cosine: float):
    reach = (2 - 2 * min(cosine, 1)) ** 0.5 + 1e-6  # unit vectors that link are no further apart

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Two blocks of a space (or one, twice): each class that has links between them, its root among those, and the vectors it links to."""
        rows = rows.sort_by([("root", "ascending"), ("vec_id", "ascending")])
        side, ids, roots = (rows.column(c).to_numpy() for c in ("side", "vec_id", "root"))
        weight = rows.column("weight").to_numpy()
        x = _flat(rows.column("v").combine_chunks())[0].reshape(len(ids), -1)  # of one space, so of one length
        once = key[1].as_py() == key[2].as_py()
        one = np.flatnonzero(side == 0)
        two = one if once else np.flatnonzero(side == 1)
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        left, right = x[one], x[two]
        rough = left.astype(np.float32), right.astype(np.float32)
        strips = pieces = np.zeros(1, np.int64)
        if len(one) and len(two):
            strips, pieces = _strips(roots[one], max(1, STRIP // len(two))), _strips(roots[two], PIECE)
            (c, r), (d, s) = _balls(left, strips), _balls(right, pieces)
        for k, (at, end) in enumerate(zip(strips[:-1].tolist(), strips[1:].tolist())):
            # by the triangle inequality, no link joins strips whose balls are further apart
            may = np.repeat(np.sqrt(((d - c[k]) ** 2).sum(axis=1)) <= reach + r[k] + s, np.diff(pieces))
            least = at if once else 0
            own = np.flatnonzero(may[least:]) + least
            if 4 * len(own) > 3 * (len(two) - least):  # a copy of nearly all costs more than it saves
                i, j = _near(left[at:end], right[least:], cosine, (rough[0][at:end], rough[1][least:]))
                j += least
            else:
                i, j = _near(left[at:end], right[own], cosine, (rough[0][at:end], rough[1][own]))
                j = own[j]
            i += at
            if once:
                i, j = i[i < j], j[i < j]
            i, j = one[i], two[j]
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            apart = label[i] != label[j]
            if apart.any():
                node, root = spread(label[i[apart]], label[j[apart]])
                to = np.arange(len(ids))
                to[node] = root
                label = to[label]
        own = n > 0
        return pa.table({"vec_id": ids[own], "to": ids[label[own]], "n": n[own]})

    return run


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, to, n): every class with links in its space, once for each pair of blocks that holds some: links as stars, and their number.

    All links are found, however large a space is. Classes of one root should be near each other: what is far apart is then left out in strips.
    """
    spaces = classes.groupBy("space").agg(F.count("*").alias("size"), F.max(F.size("v")).alias("d"))
    most = F.greatest(F.least(F.greatest(F.lit(BLOCK), F.col("size") / BLOCKS), F.lit(NUMBERS) / F.col("d")), F.lit(1))
    spaces = cut(spaces.select("space", "size", F.ceil(F.col("size") / most).cast("int").alias("blocks")).where("size > 1"))
    # blocks are hashed, so that numbering them needs no pass over the space in one task
    placed = join_by_size(classes, spaces, "space", "size", classes.count()).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("space", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "vec_id", "root", "weight", "v")
    return pairs.groupBy("space", "low", "high").applyInArrow(_compare(cosine), "vec_id long, to long, n long")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each space in a batch, by component."""
    for batch in batches:
        flat, starts = _flat(batch.column("v"))
        space = batch.column("space").dictionary_encode()
        code = space.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(space.dictionary.to_pylist()):
            own = np.flatnonzero(code == k)
            d = int(starts[own[0] + 1] - starts[own[0]])
            total = flat[starts[own][:, None] + np.arange(d)].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([name] * d, pa.string()), pa.array(np.arange(d)), pa.array(total), pa.array(np.full(d, len(own)))], ["space", "place", "total", "n"])


def _keys(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, starts = _flat(batch.column("v"))
            middle, size = _flat(batch.column("mean"))[0], np.diff(starts)
            keys = np.zeros((batch.num_rows, passes), np.int64)
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                at = starts[own][:, None] + np.arange(d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * BITS))
                signs = ((flat[at] - middle[at]) @ planes[d] > 0).reshape(len(own), passes, BITS)
                keys[own] = signs @ (1 << np.arange(BITS - 1, -1, -1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(passes)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("space"), lists], ["vec_id", "space", "keys"])

    return run


def _neighbours(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        """A window of rows in order (side 0) against itself and the next one (side 1): stars of the links inside a run, which is a space in a pass."""
        rows = rows.sort_by([("run", "ascending"), ("side", "ascending")])
        ids, side, runs = rows.column("vec_id").to_numpy(), rows.column("side").to_numpy(), rows.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        flat, starts = _flat(rows.column("v").combine_chunks())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(runs)) + 1):
            x = flat[starts[own[0]] : starts[own[-1] + 1]].reshape(len(own), -1)
            first = int((side[own] == 0).sum())
            i, j = _near(x[:first], x, cosine)
            i, j = i[i < j], j[i < j]
            node, root = spread(ids[own[i]], ids[own[j]])
            a.append(node)
            b.append(root)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def passes(classes: DataFrame, cosine: float, number: int = PASSES, seed: int = 0, window: int = WINDOW) -> DataFrame:
    """(a, b): stars of the links that ``number`` sorted passes find.

    Only keys are sorted; each vector's place in the order of all passes follows from its place in its range and the sizes of the ranges before, so
    windows are the same however rows are partitioned, and none ends at the border of a range.
    """
    sums = classes.select("space", "v").mapInArrow(_added, "space string, place long, total double, n long")
    sums = sums.groupBy("space", "place").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("size"))
    means = cut(sums.groupBy("space").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda s: s["mean"]).alias("mean")))
    keys = join_by_size(classes.select("vec_id", "space", "v"), means, "space", "size", classes.count()).select("vec_id", "space", "v", "mean").mapInArrow(_keys(number, seed), "vec_id long, space string, keys array<long>")
    each = keys.select("vec_id", F.posexplode("keys").alias("pass", "sign"), "space").select("vec_id", F.concat_ws("/", "pass", "space").alias("run"), "sign")
    ranged = each.repartitionByRange("run", "sign", "vec_id").sortWithinPartitions("run", "sign", "vec_id")
    ranged = cut(ranged.select("vec_id", "run", F.monotonically_increasing_id().alias("_at")).withColumns({"part": F.shiftright("_at", 33), "place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per range
    starts = classes.sparkSession.createDataFrame(list(zip([r.part for r in sizes], np.cumsum([0, *[r.n for r in sizes]]).tolist())), "part long, start long")
    placed = ranged.join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("start") + F.col("place")) / window))
    placed = placed.select("vec_id", "run", F.explode(F.array(F.struct("block", F.lit(0).alias("side")), F.struct((F.col("block") - 1).alias("block"), F.lit(1).alias("side")))).alias("_b")).select("vec_id", "run", "_b.*")
    return placed.join(classes.select("vec_id", "v"), "vec_id").where("block >= 0").select("block", "side", "run", "vec_id", "v").groupBy("block").applyInArrow(_neighbours(cosine), "a long, b long")


def _asked(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        """Vectors of the sample (side 1) against a block: how many links each has there, and how many of those inside its component."""
        side, roots = rows.column("side").to_numpy(), rows.column("root").to_numpy()
        x = _flat(rows.column("v").combine_chunks())[0].reshape(len(side), -1)
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        i, j = _near(x[one], x[two], cosine)
        i, j = one[i], two[j]
        other = rows.column("vec_id").to_numpy()[i] != rows.column("vec_id").to_numpy()[j]
        return pa.table({"space": rows.column("space")[:1], "n": [int(other.sum())], "found": [int((other & (roots[i] == roots[j])).sum())]})

    return run


def recall(rooted: DataFrame, cosine: float, sample: int = SAMPLE) -> DataFrame:
    """(space, n, found): links of a sample of each space among all its vectors, and those that join vectors of one component (root).

    The sample is the vectors of smallest hash, at most ``sample`` a space, so the work grows with the rows alone.
    """
    size = rooted.groupBy("space").agg(F.count("*").alias("size"), F.max(F.size("v")).alias("d"))
    size = cut(size.select("space", "size", F.ceil(F.col("size") / F.greatest(F.lit(1), F.lit(NUMBERS) / F.col("d"))).cast("int").alias("blocks")))
    dealt = join_by_size(rooted, size, "space", "size", rooted.count())
    hashed = dealt.withColumn("h", F.xxhash64("vec_id", F.lit(5)))
    # hashes are even, so those below twice the share hold the sample; the exact cut follows
    few = hashed.where(F.pmod("h", F.lit(1 << 40)) < F.lit(1 << 40) * 2 * sample / F.col("size") + F.when(F.col("size") < 20 * sample, F.lit(1 << 40)).otherwise(F.lit(0)))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("space").orderBy(F.pmod("h", F.lit(1 << 40)), "vec_id"))).where(F.col("_r") <= sample)
    here = dealt.select("space", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "root", "v")
    there = few.select("space", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "vec_id", "root", "v")
    found = here.unionByName(there).groupBy("space", "block").applyInArrow(_asked(cosine), "space string, n long, found long")
    return found.groupBy("space").agg(F.sum("n").alias("n"), F.sum("found").alias("found"))


def _rooted(classes: DataFrame, stars: DataFrame) -> DataFrame:
    """Classes with root, the component that links unite them to; their own number where nothing links."""
    roots = components(stars).withColumnRenamed("node", "vec_id")
    return cut(classes.join(roots, "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id")))


def near_classes(classes: DataFrame, cosine: float) -> DataFrame:
    """links() of every space in the order of what the sorted passes unite, and their stars, which count no link twice (n is 0)."""
    stars = cut(passes(classes, cosine))
    found = links(_rooted(classes, stars), cosine)
    return found.unionByName(stars.select(F.col("a").alias("vec_id"), F.col("b").alias("to"), F.lit(0).cast("long").alias("n")))


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row per input row: vec_id, n_links, component_id and kept (vec_id = component_id).

    Every link is found and counted, whatever the size of a label.
    Vectors link if label and length agree and their cosine in double precision is at least
    ``cosine``; null labels, null, empty or zero vectors and vectors with null or non-finite components
    link with nothing. Every row is a vector of its own: rows that share a vec_id are compared, and count, each by itself.
    A row without vec_id links like any other; its component_id is the smallest vec_id reached, null if there is none, and
    it is kept only then. Other columns are ignored; an empty table gives no rows.
    """
    # equal vectors are one class with a weight and the smallest vec_id
    key = F.when(F.col("space").isNotNull(), F.concat_ws("/", "space", F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v")))
    units = cut(unit(vectors).withColumn("key", key))
    classes = units.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.min(F.struct("space", "v")).alias("s"))
    # the checkpoint fixes the number of each class
    classes = cut(classes.select("key", F.monotonically_increasing_id().alias("vec_id"), "least", "weight", "s.*"))
    found = cut(near_classes(classes, cosine))
    roots = cut(components(found.select(F.col("vec_id").alias("a"), F.col("to").alias("b"))))
    members = roots.withColumnRenamed("node", "vec_id").join(classes.select("vec_id", "least"), "vec_id")
    least = cut(members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    n = found.where("n > 0").groupBy("vec_id").agg(F.sum("n").alias("n"))
    linked = join_by_size(roots.withColumnRenamed("node", "vec_id"), least, "root", "size", roots.count()).select("vec_id", "component_id", F.lit(True).alias("in")).join(n, "vec_id")
    found = classes.select("key", "vec_id", "least", "weight").join(linked, "vec_id", "left")
    found = cut(found.select("key", "weight", F.when(F.col("in"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n")))
    out = join_by_size(units.select("vec_id", "key"), found, "key", "weight", units.count(), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
