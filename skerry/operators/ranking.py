"""Vector ranking, pools and cutoffs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.cuts import cut, shared_folder
from skerry.plans.shipping import ship
from skerry.sources.fetching import file_system

#: Leaves and documents that are multiplied at once.
BLOCK, ROWS = 4096, 2048


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector (FN13)."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda n, v: n + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length one in double precision, and which have a direction; null vectors have none, null components count as none either."""
    known = np.array([v.is_valid and len(v.values) == size for v in column], bool) if column.null_count or not _even(column, size) else np.ones(len(column), bool)
    out = np.zeros((len(column), size))
    if known.any():
        inside = column.filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[known] = inside.reshape(-1, size)
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    known &= np.isfinite(norms) & (norms > 0)
    out[~known] = 0
    norms[~known] = 1
    return out / norms[:, None], known


def _even(column: pa.Array, size: int) -> bool:
    return len(column) * size == len(column.flatten())


def _written_leaves(leaves: DataFrame) -> str:
    """The leaves as files in the shared folder, which tasks read a block at a time."""
    place = f"{shared_folder(leaves.sparkSession)}/leaves-{uuid.uuid4().hex}"
    leaves.select("concept_id", "leaf_vector").write.parquet(place)
    return place


def _blocks(place: str, rows: int) -> Iterator[pa.RecordBatch]:
    system, path = file_system(place)
    files = sorted(f.path for f in system.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet"))
    for file in files:
        with pq.ParquetFile(file, filesystem=system) as part:
            yield from part.iter_batches(batch_size=rows)


def _against(documents: DataFrame, leaves: DataFrame, digits: int, chosen: Callable[[list], tuple], out: str) -> DataFrame:
    """Each Arrow batch of documents against all leaves, a block of leaves at a time, by matrix products; no row is shuffled.

    ``chosen`` gets the running choice, (row, concept_id, score), and a block's scores, and returns the new choice.
    """
    ship(documents.sparkSession)
    place, rows, block_rows = _written_leaves(leaves), ROWS, BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                for block in _blocks(place, block_rows):
                    size = max(len(block.column(1).flatten()) // max(1, len(block) - block.column(1).null_count), 1)
                    (mine, here), (theirs, there) = _unit(batch.column(1), size), _unit(block.column(1), size)
                    scores = np.round(mine @ theirs.T, digits)
                    scores[~here] = scores[:, ~there] = -np.inf  # no direction, no score
                    found = chosen(found, scores, block.column(0).to_numpy())
                row, concept, score = found
                score = pa.array(np.where(np.isinf(score), 0.0, score + 0.0), mask=np.isinf(score))
                columns = [batch.column(0).take(pa.array(row)), pa.array(concept).cast(concept_type), score]
                if rank:
                    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
                    columns.append(pa.array(np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) + 1, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rank = out.endswith("rank int")
    document, concept = documents.schema["document_id"].dataType.simpleString(), leaves.schema["concept_id"].dataType
    concept_type = pa.int32() if concept.simpleString() == "int" else pa.int64()
    names = ["document_id", "concept_id", "score", *(["rank"] if rank else [])]
    return documents.select("document_id", "vector").mapInArrow(run, f"document_id {document}, concept_id {concept.simpleString()}, {out}")


def pool(documents: DataFrame, leaves: DataFrame, size: int, digits: int = 6) -> DataFrame:
    """The nearest ``size`` leaves of each document: (document_id, concept_id, score, rank) (JN07, WIN01, WIN04, TOP01).

    Exact: each document keeps its best ``size`` over the blocks of leaves, ties by the smaller id, pairs
    without a score (null or zero vectors) last.  Ids are integers.
    """

    def best(found: tuple, scores: np.ndarray, ids: np.ndarray) -> tuple:
        if scores.shape[1] > size:
            least = -np.partition(-scores, size - 1, axis=1)[:, size - 1]
            row, column = np.nonzero(scores >= least[:, None])  # with all ties of the last one
        else:
            row, column = (x.ravel() for x in np.indices(scores.shape))
        row, concept, score = (np.concatenate(x) for x in zip(found, (row, ids[column], scores[row, column]), strict=True))
        order = np.lexsort((concept, -score, row))
        row, concept, score = row[order], concept[order], score[order]
        starts = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1] if len(row) else np.zeros(0, np.int64)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        keep = place < size
        return row[keep], concept[keep], score[keep]

    return _against(documents, leaves, digits, best, "score double, rank int")


def similar(documents: DataFrame, leaves: DataFrame, least: float, digits: int = 6) -> DataFrame:
    """(document_id, concept_id, score) of those at least so alike (JN06, RT03), kept where they are scored, without a shuffle."""

    def enough(found: tuple, scores: np.ndarray, ids: np.ndarray) -> tuple:
        row, column = np.nonzero(scores >= least)
        return tuple(np.concatenate(x) for x in zip(found, (row, ids[column], scores[row, column]), strict=True))

    return _against(documents, leaves, digits, enough, "score double")


def adaptive(ranked: DataFrame, min_score: float, margin: float, max_k: int, by: str = "document_id") -> DataFrame:
    """``kept``: within ``margin`` of the best score, at least ``min_score``, and among the first ``max_k`` (FLT22, WIN02)."""
    best = F.max("score").over(Window.partitionBy(by))
    return ranked.withColumn("kept", (F.col("score") >= F.greatest(F.lit(min_score), best - margin)) & (F.col("rank") <= max_k))


def fixed(ranked: DataFrame, top_k: int) -> DataFrame:
    return ranked.withColumn("kept", F.col("rank") <= top_k)


def cutoff_report(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs kept, per document, documents with none, and recall split into pool and cutoff (AGG41)."""
    per = ranked.groupBy("document_id").agg(F.count_if("kept").alias("kept"))
    sums = per.agg(
        F.sum("kept").alias("pairs"), F.round(F.avg(F.col("kept").cast("double")), 6).alias("per_document"), F.count_if(F.col("kept") == 0).alias("documents_with_none"), F.count("*").alias("documents")
    )
    hits = truth.where("matched").join(ranked.select("document_id", "concept_id", "kept"), ["document_id", "concept_id"], "left")
    recall = hits.agg(F.count("*").alias("positives"), F.count("kept").alias("in_pool"), F.count_if("kept").alias("kept_positives"))
    return sums.crossJoin(recall)


def kept_histogram(ranked: DataFrame) -> DataFrame:
    """How many documents keep how many (AGG08)."""
    return ranked.groupBy("document_id").agg(F.count_if("kept").alias("kept")).groupBy("kept").agg(F.count("*").alias("documents"))


#: Rows that the axes and centres of ``near_pairs`` are fitted on, how many of each, and the vectors of a cell that meet in one task.
FIT, AXES, CENTRES, CELL = 4096, 16, 64, 4096


def _fitted(vectors: DataFrame, axes: int, centres: int) -> tuple[np.ndarray, np.ndarray]:
    """A turned basis whose first axes hold most of the vectors' length, and centres far from each other: from FIT rows at most."""
    rows = vectors.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("concept_id"), "concept_id").limit(FIT).select("vector").toArrow()["vector"]
    size = len(rows[0].values) if len(rows) else 1
    unit, known = _unit(rows.combine_chunks() if len(rows) else pa.array([], pa.list_(pa.float64())), size)
    unit = unit[known]
    if not len(unit):
        return np.eye(size), np.zeros((1, size))
    turn = np.linalg.svd(unit.T @ unit)[0]
    picked = [0]
    nearest = unit @ unit[0]
    while len(picked) < min(centres, len(unit)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[picked[-1]])
    return turn, unit[picked]


def near_pairs(vectors: DataFrame, threshold: float, digits: int = 6, counts: bool = False) -> DataFrame:
    """Pairs of classes at least ``threshold`` alike, a < b (JN27), without comparing all.

    Exact.  Each vector is in the cell of its nearest centre.  By the triangle inequality on angles, two cells
    whose centres are further apart than their radii and the threshold's angle hold no pair and don't meet.  Where
    cells meet, the first AXES coordinates and the lengths of the rest bound each cosine from above; only
    pairs that the bound allows are compared.  A cell is cut into parts of CELL vectors.  Null and zero vectors are in no pair.
    With ``counts``, one row: ``pairs`` there are, ``met`` in cells, ``compared`` in full, ``found``.
    """
    spark = vectors.sparkSession
    ship(spark)
    known = cut(vectors.select("concept_id", "vector"))
    turn, centres = _fitted(known, AXES, CENTRES)
    size, slack, limit = turn.shape[0], 1e-9, threshold - 0.5 * 10.0**-digits

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, good = _unit(batch.column(1), size)
            unit = unit[good]
            near = unit @ centres.T
            cell = near.argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(unit)), cell], -1, 1))
            turned = pa.ListArray.from_arrays(np.arange(0, unit.size + 1, size, dtype=np.int32), pa.array((unit @ turn).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(cell), pa.array(angle), turned], names=["concept_id", "cell", "angle", "turned"])

    kind = vectors.schema["concept_id"].dataType.simpleString()
    cells = cut(known.mapInArrow(placed, f"concept_id {kind}, cell long, angle double, turned array<double>"))
    # CENTRES rows at most
    sizes = {r.cell: (r.n, r.radius) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1))
    reach = np.arccos(np.clip(limit, -1, 1)) + slack
    parts = {c: -(-n // CELL) for c, (n, _) in sizes.items()}
    meeting = [(x, y) for x in sorted(sizes) for y in sorted(sizes) if x <= y and (x == y or apart[x, y] - sizes[x][1] - sizes[y][1] <= reach)]
    # for each part of a cell the tasks it goes to, with its side; a cell meets CENTRES others at most
    goes: list[tuple[int, int, str, int]] = []
    for x, y in meeting:
        for i in range(parts[x]):
            for j in range(i if x == y else 0, parts[y]):
                goes.append((x, i, f"{x}.{i}-{y}.{j}", 0))
                if (x, i) != (y, j):
                    goes.append((y, j, f"{x}.{i}-{y}.{j}", 1))
    tasks = spark.createDataFrame(goes or [(-1, 0, "", 0)], "cell long, part int, task string, side int")
    count = spark.createDataFrame([(c, p) for c, p in parts.items()] or [(-1, 1)], "cell long, parts int")
    dealt = cells.join(F.broadcast(count), "cell").withColumn("part", F.pmod(F.xxhash64("concept_id"), F.col("parts")).cast("int"))
    sent = dealt.join(tasks, ["cell", "part"]).select("task", "side", "concept_id", "turned").repartition("task").sortWithinPartitions("task", "side")

    def compared(left: tuple, right: tuple, same: bool) -> tuple[list, int, int]:
        found, met, full = [], 0, 0
        for s in range(0, len(left[0]), 1024):
            a, ids = left[1][s : s + 1024], left[0][s : s + 1024]
            for t in range(s if same else 0, len(right[0]), 1024):
                b, others = right[1][t : t + 1024], right[0][t : t + 1024]
                rest = np.sqrt(np.einsum("ij,ij->i", a[:, AXES:], a[:, AXES:])), np.sqrt(np.einsum("ij,ij->i", b[:, AXES:], b[:, AXES:]))
                may = a[:, :AXES] @ b[:, :AXES].T + np.outer(*rest) >= limit - slack
                if same and s == t:
                    may = np.triu(may, 1)
                met += may.size if not (same and s == t) else may.shape[0] * (may.shape[0] - 1) // 2
                i, j = np.nonzero(may)
                full += len(i)
                score = np.round(np.einsum("ij,ij->i", a[i], b[j]), digits)
                good = score >= threshold
                found.append((np.minimum(ids[i], others[j])[good], np.maximum(ids[i], others[j])[good], score[good]))
        return found, met, full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {0: [], 1: []}

        def told() -> Iterator[pa.RecordBatch]:
            sides = {k: (np.concatenate([x for x, _ in v]), np.concatenate([y for _, y in v])) for k, v in held.items() if v}
            if 0 not in sides:
                return
            found, met, full = compared(sides[0], sides.get(1, sides[0]), 1 not in sides)
            a, b, score = (np.concatenate([f[k] for f in found]) for k in range(3))
            if counts:
                a, b, score, extra = a[:0], b[:0], score[:0], (met, full, len(a))
            else:
                extra = (0, 0, 0)
            n = max(len(a), 1) if counts else len(a)
            fill = lambda x, t: pa.array(np.resize(x, n), t) if len(x) else pa.nulls(n, t)
            columns = [fill(a, concept), fill(b, concept), fill(score, pa.float64()), *(pa.array([e] * n, pa.int64()) for e in extra)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "score", "met", "compared", "found"])

        for batch in batches:
            task, side, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows = batch.column(3).flatten().to_numpy().reshape(-1, size)
            edges = np.r_[0, np.flatnonzero((task[1:] != task[:-1]) | (side[1:] != side[:-1])) + 1, len(task)] if len(task) else [0]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if task[begin] != now:
                    yield from told()
                    now, held = task[begin], {0: [], 1: []}
                held[side[begin]].append((ids[begin:end].copy(), rows[begin:end].copy()))
        yield from told()

    concept = pa.int32() if kind == "int" else pa.int64()
    out = sent.mapInArrow(run, f"a {kind}, b {kind}, score double, met long, compared long, found long")
    if not counts:
        return out.select("a", "b", "score")
    n = cells.count()
    return out.agg(F.lit(n * (n - 1) // 2).cast("long").alias("pairs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "compared", "found")))


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The newest row of each group (WIN03): an aggregation, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest))


def budget(rows: DataFrame, limit: int, by: list[str], score: str = "score", ties: tuple[str, ...] = ("document_id", "concept_id")) -> DataFrame:
    """The best ``limit`` rows of each group (TOP05)."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def capped(rows: DataFrame, limit: int, cap: int, by: str = "concept_id", order: tuple[Column, ...] = ()) -> DataFrame:
    """``limit`` rows with at most ``cap`` of each group, filled up from the rest if those don't suffice (WIN09).

    The rows over the cap only matter up to ``limit``, so both parts are cut to it first.
    """
    within = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    ranked = rows.withColumn("_over", (within > cap).cast("int"))
    return ranked.orderBy("_over", *order).limit(limit).drop("_over")


def split_remainder(total: Column, parts: Column, position: Column) -> Column:
    """An integer split over ``parts``; the first position takes the remainder (WIN10)."""
    return F.floor(total / parts).cast("long") + F.when(position == 0, total % parts).otherwise(0)
