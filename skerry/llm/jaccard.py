"""Exact n-gram Jaccard join by a token-group matrix.

Two documents link when ``100 * intersection >= percent * union`` of their sets
of word shingles ("tokens" here).  All steps are exact:

1. Documents with equal sets are one: the smallest id stands for all.
2. Partitioning into groups of similar documents.  Each set gives keys such that
   linked sets share one (see ``part_keys`` and ``rarest_keys``).  Where up to
   PAIR_LIMIT documents share a key, each pair is kept if the parities of their
   tokens over a bitmap, which differ in no more bits than the sets differ in
   tokens, allow a link.  Where more do, they are put together as they are.
   Candidates are joined transitively: no link leaves a group.  Keys that many
   documents share are counted and joined apart from the others, so that no task
   gets all of one.
3. Within a group, a core set is chosen, the tokens that most members have.  A
   member is kept as its difference from the core.  As differences cancel,
   ``|A ^ B| = |Da ^ Db|`` for any core, so members near the core link to the one
   nearest to it without being compared with each other.
4. The rest uses the token-group matrix: members are partitioned into subgroups
   by a shared difference token, each subgroup stores the union of its members'
   tokens, and for each remaining query the overlap with a union bounds the
   overlap with every member.  Only subgroups whose bound qualifies are opened and
   compared exactly; those already joined with the query are skipped.

Groups of more than ``GROUP_LIMIT`` members or ``GROUP_TOKENS`` tokens are cut into
blocks and go by pairs of blocks, so that a task holds two blocks at most.
Components come from the links found, which span each component.

Null and empty texts have no shingles and link with nothing.  Rows with equal ids
are one document: it links where one of its texts does, all its rows get the
same component, and each row the size of its own set.  Rows with a null id are found by
nobody and get the component of their text's other rows, if there are any.  Repeated
rows give a row each, ties go to the smallest id, an empty table gives an empty
table.  Very long texts are held whole, one at a time, by the task that reads them.
Extra columns are ignored, whatever their names.  Shingles are compared by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import shingles
from skerry.operators.components import connected_components
from skerry.plans.cuts import cut
from skerry.plans.sieve import likely, without
from skerry.plans.skew import looked_up
from skerry.plans.shipping import ship

GROUP_LIMIT = 4096
GROUP_TOKENS = 1 << 22
PAIR_LIMIT = 32
CLASS_RATIO = 1.3
SKETCH_BITS = 20
SKETCH_RUN = 1 << 20
#: One text in so many counts for tokens that are too rare to recur within a run; they have to be in so many of these texts.
SKETCH_SHARE, SKETCH_LEAST = 32, 3
#: Rows whose texts are hashed together.
SLICE = 128
#: Cells in which keys are counted to find those that many share.
KEY_CELLS = 1 << 16
#: A cell with one in so many of all keys is crowded; there are so many crowded cells at most.
CROWDED = 1000


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (shingles.mixed(tokens) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How often tokens recur, by cell: a table of 2 ** SKETCH_BITS counts over all documents.

    Within runs of SKETCH_RUN tokens, what recurs at least three times is counted.  In a
    large corpus this misses tokens of hundreds of documents, which would put all of these
    together; so the tokens of one text in SKETCH_SHARE are counted over all runs.  The
    sketch serves the order of tokens alone, which no result depends on.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        held: list[np.ndarray] = []
        sampled: list[np.ndarray] = []

        def rows_of(cells: np.ndarray, tokens: np.ndarray | None, times: np.ndarray) -> pa.RecordBatch:
            known = pa.nulls(len(cells), pa.int64()) if tokens is None else pa.array(tokens.astype(np.int64))
            return pa.RecordBatch.from_arrays([known, pa.array(cells), pa.array(times.astype(np.int64))], names=["token", "cell", "n"])

        def counted() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sampled]), return_counts=True)
            sampled.clear()
            return rows_of(_cells(tokens), tokens, times)

        def note() -> None:
            if held:
                tokens, times = np.unique(np.concatenate(held), return_counts=True)
                often = times > 2
                np.add.at(counts, _cells(tokens[often]), times[often])
                held.clear()

        size = drawn = 0
        for batch in rows:
            for begin in range(0, batch.num_rows, SLICE):
                for tokens in shingles.shingle_sets(batch.column(0).slice(begin, SLICE).to_pylist(), width):
                    held.append(tokens)
                    size += len(tokens)
                    if size > SKETCH_RUN:
                        note()
                        size = 0
                    # by its set, so that equal sets are drawn together
                    if shingles.mixed(tokens.sum(keepdims=True, dtype=np.uint64))[0] % np.uint64(SKETCH_SHARE) == 0:
                        sampled.append(tokens)
                        drawn += len(tokens)
                        if drawn > SKETCH_RUN // 4:
                            yield counted()
                            drawn = 0
        note()
        yield counted()
        found = np.flatnonzero(counts)
        yield rows_of(found, None, counts[found])

    known = docs.select(text).mapInArrow(run, "token long, cell long, n long").groupBy("token", "cell").agg(F.sum("n").alias("n"))
    enough = known.where(F.col("token").isNull() | (F.col("n") >= SKETCH_LEAST))
    whole = F.when(F.col("token").isNull(), F.col("n")).otherwise(F.col("n") * SKETCH_SHARE)
    cells = enough.groupBy("cell").agg(F.sum(whole).alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    sketch[cells["cell"].to_numpy()] = np.minimum(cells["n"].to_numpy(), 2**32 - 1)
    return sketch


def by_parts(percent: int) -> bool:
    """Whether parts of sets hold enough tokens, seven or so, to tell documents apart; else the rarest tokens do better."""
    return 100 + percent >= 5 * CLASS_RATIO * 2 * (100 - percent)


@lru_cache(maxsize=1)
def _class_edges() -> list[int]:
    """Smallest sizes of the size classes, up to sizes that no text has."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * CLASS_RATIO)))
    return edges


def part_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys from parts of the set.

    Linked sets of sizes a and b differ in at most (a + b) * (100 - percent) /
    (100 + percent) tokens.  If tokens are dealt by hash into more parts than that,
    a part is the same in both.  The larger set is in size class c; the smaller one
    is as well, or its size reaches into it, and then it gives keys for c too.  Some
    parts more are dealt, so that either side may leave out its smallest parts.
    """
    edges, n = _class_edges(), len(tokens)
    c = own = int(np.searchsorted(edges, n, "right")) - 1
    blended, keys = shingles.mixed(tokens), []
    while c == own or 100 * n >= percent * edges[c]:
        most = 2 * (edges[c + 1] - 1) * (100 - percent) // (100 + percent)
        if most:  # else only equal sets link
            spare = most // 12
            parts = most + 1 + 2 * spare
            part = ((tokens >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
            sizes = np.bincount(part, minlength=parts)
            full, sums = np.flatnonzero(sizes), np.zeros(parts, np.uint64)
            sums[full] = np.add.reduceat(blended[np.argsort(part, kind="stable")], (np.cumsum(sizes) - sizes)[full])
            chosen = np.argsort(sizes, kind="stable")[spare:].astype(np.uint64)
            keys.append(shingles.mixed(sums[chosen.astype(np.int64)] + shingles.mixed(chosen + np.uint64(c << 32))))
        c += 1
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def rarest_keys(tokens: np.ndarray, percent: int, sketch: np.ndarray) -> np.ndarray:
    """Keys from the set's rarest tokens.

    All tokens have one fixed order, those that the sketch counts as frequent last.
    As a partner shares ``percent`` of all tokens, the first ``n - ceil(percent * n /
    100) + 1`` hold one of its own first.  The order only affects the time.
    """
    n = len(tokens)
    first = n - -(-percent * n // 100) + 1
    rarest = tokens[np.lexsort((tokens, sketch[_cells(tokens)]))[:first]]
    size_class, keys = n.bit_length(), []
    for c in (size_class, size_class + 1):
        if c == size_class or 100 * n >= percent << (c - 1):
            keys.append(shingles.mixed(rarest + np.uint64(c)))
    return np.concatenate(keys)


def parities(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits a token: each bit is the parity of the tokens that fall on it."""
    words = max(1, 1 << max(0, len(tokens).bit_length() - 5))
    bits = np.bincount((shingles.mixed(tokens) & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _may_link(percent: int) -> Column:
    """Whether the parities of documents i and j, of which either bitmap may have twice the other's length, allow a link."""

    def folded(bits: Column, other: Column) -> Column:
        half = F.size(other)
        halves = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > half, halves).otherwise(bits)

    apart = F.zip_with(folded(F.col("bits_i"), F.col("bits_j")), folded(F.col("bits_j"), F.col("bits_i")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    least = F.aggregate(apart, F.lit(0), lambda n, x: n + x)
    return (100 + percent) * least <= (100 - percent) * (F.col("n_i") + F.col("n_j"))


def _profiles(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(doc, n, digest, keys, bits) of each row; the digest of an empty set is null."""
    parts = by_parts(percent)
    # 4 MB, whatever the size of the corpus
    shared = docs.sparkSession.sparkContext.broadcast(None if parts else frequency_sketch(docs, text, width))

    def keys_of(tokens: np.ndarray) -> np.ndarray:
        return part_keys(tokens, percent) if parts else rarest_keys(tokens, percent, shared.value)

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, arrays)])
        flat = np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for begin in range(0, batch.num_rows, SLICE):
                some = batch.slice(begin, SLICE)
                n, digests, keys, bits = [], [], [], []
                for tokens in shingles.shingle_sets(some.column(1).to_pylist(), width):
                    n.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                    keys.append(keys_of(tokens) if len(tokens) else tokens)
                    bits.append(parities(tokens))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists(keys), lists(bits)],
                    names=["doc", "n", "digest", "keys", "bits"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc {kind}, n long, digest binary, keys array<long>, bits array<long>")


def _several(profiles: DataFrame) -> DataFrame:
    """Ids that occur with unequal sets."""
    known = profiles.where("digest IS NOT NULL AND doc IS NOT NULL").groupBy("doc").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high"))
    return cut(known.where("low <> high").select("doc"))


def _bucketed(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found_by, doc, hub, size) of keys (doc, found_by) that several documents share, and (found_by, docs) of those that few do."""
    cell = F.pmod(F.xxhash64("found_by"), F.lit(KEY_CELLS))
    cells = cut(keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    # CROWDED cells at most
    crowded = F.broadcast(cells.where((F.col("n") * CROWDED >= total) & (F.col("n") > KEY_CELLS)).select("cell"))
    placed = keys.withColumn("cell", cell)
    usual = placed.join(crowded, "cell", "left_anti").drop("cell").repartition("found_by")
    hot = placed.join(crowded, "cell", "left_semi").drop("cell")

    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy("found_by").agg(F.min("doc").alias("hub"), F.count("*").alias("size")).where("size > 1")

    heavy = cut(counted(hot))
    in_heavy = looked_up(hot, heavy.withColumn("weight", F.col("size")), ("found_by",), "weight", F.xxhash64("doc")).where("hub IS NOT NULL")
    shared = usual.join(counted(usual), "found_by")
    few = F.col("size") <= PAIR_LIMIT
    stars = shared.where(~few).unionByName(in_heavy.where(~few))

    def listed(some: DataFrame) -> DataFrame:
        return some.where(few).groupBy("found_by").agg(F.sort_array(F.collect_list("doc")).alias("docs"))

    return stars, listed(shared).unionByName(listed(in_heavy))


def _candidates(profiles: DataFrame, reps: DataFrame, several: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold all links; ids in ``several`` have no bitmap of their own."""
    # copies of a set, but for its first holder
    copies = cut(_with_rep(profiles.select("doc", "digest"), reps).where("doc <> rep").select("doc", "digest"))
    own = without(profiles.select("doc", "digest", "keys"), copies, "doc", "digest")
    shared, few = _bucketed(own.select("doc", F.explode("keys").alias("found_by")))
    stars = shared.select(F.col("doc").alias("a"), F.col("hub").alias("b")).where("a > b").distinct()
    later = F.transform(
        F.col("docs"), lambda x, i: F.transform(F.slice(F.col("docs"), i + 2, F.size("docs")), lambda y: F.struct(y.alias("i"), x.alias("j")))
    )
    pairs = few.select(F.inline(F.flatten(later))).where("i > j").distinct()
    sides = without(profiles.where("digest IS NOT NULL").select("doc", "n", "bits"), several, "doc").dropDuplicates(["doc"])
    for side in "ij":
        pairs = pairs.join(sides.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side, "left")
    allowed = F.col("bits_i").isNull() | F.col("bits_j").isNull() | _may_link(percent)
    return pairs.where(allowed).select(F.col("i").alias("a"), F.col("j").alias("b")).union(stars)


def _with_rep(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (doc, digest) with ``rep``, the first holder of the set; a set that most rows have doesn't meet in one task."""
    return looked_up(rows, reps, ("digest",), "copies", F.xxhash64("doc"))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def group_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components among the sets; positions in the list."""
    count = len(sets)
    sizes = [len(s) for s in sets]
    tokens, holders = np.unique(np.concatenate(sets), return_counts=True)
    core = tokens[2 * holders > count]
    differences = [np.setxor1d(s, core, assume_unique=True) for s in sets]
    # a and b link if (100 + percent) * |Da ^ Db| <= (100 - percent) * (a + b); |Da ^ Db| <= |Da| + |Db|
    near, far = 100 - percent, 100 + percent
    excess = [far * len(d) - near * n for d, n in zip(differences, sizes, strict=True)]
    middle = min(range(count), key=excess.__getitem__)
    union, links = _Union(count), []

    def link(i: int, j: int) -> None:
        if union.join(i, j):
            links.append((i, j))

    rest = []
    for i in range(count):
        if i != middle:
            if excess[i] + excess[middle] <= 0:
                link(i, middle)
            else:
                rest.append(i)
    if not rest:
        return links

    # matrix: for each difference token that several members have, the subgroups whose union has it
    # tokens of one member alone, most of them where members are unlike, never become Python objects
    tokens, holders = np.unique(np.concatenate(differences), return_counts=True)
    tokens, holders = tokens[holders > 1], holders[holders > 1]
    shared = dict(zip(tokens.tolist(), holders.tolist(), strict=True))
    overlapping = [d[np.searchsorted(tokens, d, "right") > np.searchsorted(tokens, d)].tolist() for d in differences]
    members: dict[int, list[int]] = defaultdict(list)
    for i, found in enumerate(overlapping):
        if found:
            members[min(found, key=lambda t: (-shared[t], t))].append(i)
    matrix: dict[int, set[int]] = defaultdict(set)
    for g, inside in members.items():
        for i in inside:
            for t in overlapping[i]:
                matrix[t].add(g)
    least = {g: min(excess[i] for i in inside) for g, inside in members.items()}
    as_sets: dict[int, frozenset] = {}

    def of(i: int) -> frozenset:
        if i not in as_sets:
            as_sets[i] = frozenset(overlapping[i])
        return as_sets[i]

    for q in rest:
        bound = Counter(g for t in overlapping[q] for g in matrix[t])
        for g, overlap in bound.items():
            # members need 2 * far * |Dq & Dm| >= excess q + excess m
            if 2 * far * overlap < excess[q] + least[g]:
                continue
            for m in members[g]:
                if union.find(q) != union.find(m) and 2 * far * len(of(q) & of(m)) >= excess[q] + excess[m]:
                    link(q, m)
    return links


def _links_in_groups(docs: DataFrame, members: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) within the groups; ``members`` has (doc, component, n)."""
    sizes = members.groupBy("component").agg(F.count("*").alias("_size"), F.sum("n").alias("_tokens"))
    blocks = F.greatest(F.ceil(F.col("_size") / GROUP_LIMIT), F.ceil(F.col("_tokens") / GROUP_TOKENS)).cast("int")
    own = F.pmod(F.xxhash64("doc"), F.col("_blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(F.col("_own"), o).alias("x"), F.greatest(F.col("_own"), o).alias("y"))
    )
    tasks = (
        members.join(sizes, "component")
        .withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .select("doc", "component", F.explode(pairs).alias("_pair"))
        .select("doc", F.xxhash64("component", "_pair.x", "_pair.y").alias("task"))
    )

    def solve(ids: list, sets: list[np.ndarray]) -> list[tuple]:
        return [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in group_links(sets, percent)] if len(ids) > 1 else []

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, sets = None, [], []
        for batch in rows:
            for begin in range(0, batch.num_rows, SLICE):
                some, found = batch.slice(begin, SLICE), []
                texts = shingles.shingle_sets(some.column(2).to_pylist(), width)
                for t, doc, tokens in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts, strict=True):
                    if t != task:
                        found += solve(ids, sets)
                        task, ids, sets = t, [], []
                    ids.append(doc)
                    sets.append(tokens)
                yield _pairs(found, kind)
        yield _pairs(solve(ids, sets), kind)

    spark_kind = docs.schema[key].dataType.simpleString()
    kind = pa.int32() if spark_kind == "int" else pa.string() if spark_kind == "string" else pa.int64()
    # Spark doesn't know how many blocks a row is sent to, so it might take the tasks for a small table
    texts = likely(docs.select(F.col(key).alias("doc"), F.col(text).alias("_text")), members, "doc").join(tasks.hint("merge"), "doc")
    return (
        texts.repartition("task")
        .sortWithinPartitions("task")
        .select("task", "doc", "_text")
        .mapInArrow(run, f"a {spark_kind}, b {spark_kind}")
        .where("a <> b")
    )


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind)], names=["a", "b"])


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(key, ``n_shingles``, ``component_id``) of each row.

    ``component_id`` is the smallest key that links lead to.  Keys are integers or
    strings.
    """
    ship(docs.sparkSession)
    profiles = cut(_profiles(docs, key, text, width, percent))
    sets = profiles.where("digest IS NOT NULL")
    alike = cut(sets.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))
    several = _several(profiles)
    groups = connected_components(_candidates(profiles, alike, several, percent)).withColumnRenamed("node", "doc")
    members = cut(groups.join(sets.groupBy("doc").agg(F.sum("n").alias("n")), "doc"))
    links = _links_in_groups(docs, members, key, text, width, percent)
    # an id with unequal sets links to the first holder of each
    own = _with_rep(likely(sets.select("doc", "digest"), several, "doc").join(several, "doc", "left_semi"), alike)
    labels = connected_components(links.union(own.where("doc <> rep").select(F.greatest("doc", "rep"), F.least("doc", "rep"))))
    reps = alike.join(labels, alike["rep"] == labels["node"], "left").select("digest", "copies", F.coalesce("component", "rep").alias("component_id"))
    found = _with_rep(profiles.select("doc", "n", "digest"), cut(reps))
    return found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those whose component holds a smaller key; rows with equal or null keys stay."""
    copies = jaccard_components(docs, key, text, width, percent).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return without(docs, cut(copies), key)
