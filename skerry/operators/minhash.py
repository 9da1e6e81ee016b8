"""Near-duplicate grouping by MinHash signatures with stable representatives.

Signatures come from one fused Arrow pass.  Documents with equal signatures are one
before any join.  Candidates share a band; they are verified by the share of equal
slots, and what is kept of them are links enough to hold the groups together.  Representatives never chain: a copy points at a representative, and one
that was a representative before stays one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.components import connected_components
from skerry.plans.cuts import cut
from skerry.plans.keyed import KeyedTable
from skerry.plans.shipping import ship
from skerry.plans.skew import looked_up
from skerry.plans.store import Manifest

WIDTH, SLOTS, BAND = 5, 64, 4
MIN_SHINGLES = 20
PRIME = (1 << 31) - 1
#: Signatures that one task compares with how many others.
QUERIES, MEMBERS = 512, 16384

_draw = np.random.default_rng(31)
_FACTORS = _draw.integers(1, PRIME, SLOTS, np.int64).astype(np.uint64)
_OFFSETS = _draw.integers(0, PRIME, SLOTS, np.int64).astype(np.uint64)


def text_shingles(text: str | None) -> np.ndarray:
    """Distinct runs of five words as 31-bit hashes (FN14); a shorter text is one run."""
    words = re.findall(r"\w+", (text or "").lower())
    starts = range(min(WIDTH, len(words)))
    runs = set(map(" ".join, zip(*(words[i:] for i in starts), strict=False))) if len(words) >= WIDTH else {" ".join(words)} if words else set()
    digests = b"".join([hashlib.blake2b(r.encode(), digest_size=4).digest() for r in runs])
    return (np.frombuffer(digests, ">u4") & PRIME).astype(np.int64)


def _modulo(values: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 62 modulo PRIME, in place: as PRIME is 2 ** 31 - 1, the bits above the 31st are added to those below."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    for _ in range(2):
        high = values >> bits
        values &= prime
        values += high
    values[values == prime] = 0
    return values


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation (FN15)."""
    out = np.full(SLOTS, PRIME, np.uint64)
    whole = _modulo(shingles.astype(np.uint64))
    for begin in range(0, len(whole), 512):
        values = np.multiply.outer(_FACTORS, whole[begin : begin + 512])
        values += _OFFSETS[:, None]
        np.minimum(out, _modulo(values).min(axis=1), out=out)
    return out.astype(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    """(document_id, shingles, signature) of (document_id, body)."""
    ship(documents.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(1).to_pylist()
            signed: dict[str | None, tuple[int, list[int]]] = {}  # equal texts of a batch are signed once
            for text in texts:
                if text not in signed:
                    runs = text_shingles(text)
                    signed[text] = len(runs), signature(runs).astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([signed[t][0] for t in texts], pa.int32()), pa.array([signed[t][1] for t in texts], pa.list_(pa.int32()))], names=["document_id", "shingles", "signature"]
            )

    return documents.select("document_id", "body").mapInArrow(run, "document_id long, shingles int, signature array<int>")


def similarity(a: Column, b: Column) -> Column:
    """The share of equal slots (FN16)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / SLOTS


def _bands(signed: DataFrame) -> DataFrame:
    """A row for each band of each signature: (first, signature, band, slots)."""
    numbers = F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1))
    keys = F.transform(numbers, lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", i * BAND + 1, F.lit(BAND))).alias("slots")))
    return signed.select("first", "signature", F.inline(keys))


def near_links(signed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b) with a > b: links that hold together all documents that share a band and are similar enough (JN18).

    Each document links to the first of its signature.  In a bucket of a band every
    signature meets the bucket's smallest id; only those unlike it are compared with the
    others, in blocks, so a bucket that holds most rows takes neither one task nor all its pairs.
    """
    long = signed.where(F.col("shingles") >= MIN_SHINGLES)
    firsts = cut(long.groupBy("signature").agg(F.min("document_id").alias("first"), F.count("*").alias("copies")))
    same = looked_up(long.select("document_id", "signature"), firsts, ("signature",), "copies", F.xxhash64("document_id")).where("document_id > first")
    copies = same.select(F.col("document_id").alias("a"), F.col("first").alias("b"))
    own = firsts.select("first", "signature")
    keyed = _bands(own)
    sizes = keyed.groupBy("band", "slots").agg(F.count("*").alias("size"), F.min("first").alias("hub")).where("size > 1")
    hubs = sizes.join(own.select(F.col("first").alias("hub"), F.col("signature").alias("hub_signature")), "hub")
    buckets = cut(hubs.withColumn("weight", F.col("size")))
    met = looked_up(keyed, buckets, ("slots", "band"), "weight", F.xxhash64("first")).where("hub IS NOT NULL")
    linked = similarity(F.col("signature"), F.col("hub_signature")) >= threshold
    placed = cut(met.select("first", "band", "slots", "size", "hub", linked.alias("linked")))
    stars = placed.where("linked AND first > hub").select(F.col("first").alias("a"), F.col("hub").alias("b")).distinct()
    return copies.unionByName(stars).unionByName(_links_beside_hubs(placed, own, threshold))


def _links_beside_hubs(placed: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """Links of signatures that aren't like their bucket's hub; ``placed``: first, band, slots, size, linked."""
    apart = placed.where("NOT linked AND size > 2").groupBy("band", "slots").agg(F.count("*").alias("apart"), F.first("size").alias("weight"))
    inside = looked_up(placed, cut(apart), ("slots", "band"), "weight", F.xxhash64("first")).where("apart IS NOT NULL").join(own, "first")
    queries, members = (F.ceil(F.col(c) / n).cast("int") for c, n in (("apart", QUERIES), ("size", MEMBERS)))

    def dealt(rows: DataFrame, mine: Column, others: Column, is_member: int) -> DataFrame:
        each = rows.withColumn("_mine", F.pmod(F.xxhash64("first"), mine)).withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
        q, m = ("_other", "_mine") if is_member else ("_mine", "_other")
        task = F.xxhash64("band", "slots", F.col(q).cast("int"), F.col(m).cast("int"))
        return each.select(task.alias("task"), F.lit(is_member).alias("is_member"), "first", "signature")

    tasks = dealt(inside.where("NOT linked"), queries, members, 0).unionByName(dealt(inside, members, queries, 1))
    need = threshold * SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, forest = None, [], {}

        def root(x: int) -> int:
            while forest.setdefault(x, x) != x:
                forest[x] = forest[forest[x]]
                x = forest[x]
            return x

        for batch in batches:
            found = []
            task, member, ids = (batch.column(i).to_numpy() for i in range(3))
            rows = batch.column(3).flatten().to_numpy().reshape(-1, SLOTS)
            ends = [*(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for begin, end in zip([0, *ends], ends, strict=False):
                if begin == end:
                    continue
                if task[begin] != now:
                    now, asked, forest = task[begin], [], {}
                # a task's queries come first
                split = begin + int((member[begin:end] == 0).sum())
                asked += zip(ids[begin:split].tolist(), rows[begin:split].copy(), strict=True)
                for q, slots in asked:
                    for other in ids[split:end][(rows[split:end] == slots).sum(axis=1) >= need].tolist():
                        if root(other) != root(q):
                            forest[root(other)] = root(q)
                            found.append((max(q, other), min(q, other)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return tasks.repartition("task").sortWithinPartitions("task", "is_member").mapInArrow(run, "a long, b long")


def deduplicate(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(document_id, duplicate_of): null for representatives (DD01).

    Documents with ``is_junk`` set are left out: they neither are copies nor have any.
    ``documents`` may have ``duplicate_of`` from before: a document that copies
    already point at stays the representative of its group, else the smallest id is.
    """
    if "duplicate_of" not in documents.columns:
        documents = documents.withColumn("duplicate_of", F.lit(None).cast("long"))
    texts = documents.where(~F.coalesce("is_junk", F.lit(False))) if "is_junk" in documents.columns else documents
    groups = connected_components(near_links(cut(signatures(texts)), threshold)).withColumnRenamed("node", "document_id")
    standing = documents.where("duplicate_of IS NOT NULL").select(F.col("duplicate_of").alias("document_id")).distinct().withColumn("standing", F.lit(0))
    rank = F.struct(F.coalesce("standing", F.lit(1)), "document_id")
    chosen = groups.join(standing, "document_id", "left").groupBy("component").agg(F.min(rank)["document_id"].alias("chosen"))
    fresh = groups.join(chosen, "component").select("document_id", "chosen")
    joined = documents.select("document_id", "duplicate_of").join(fresh, "document_id", "left").join(standing, "document_id", "left")
    new = F.when(F.col("chosen") != F.col("document_id"), F.col("chosen"))
    # neither a copy nor a standing representative is pointed elsewhere
    return joined.select("document_id", F.when(F.col("standing").isNotNull(), None).otherwise(F.coalesce("duplicate_of", new)).alias("duplicate_of"))


class CopyIndex:
    """Near copies found batch by batch (DD01): what was signed is kept, and a batch is compared only with what shares a band with it.

    ``signatures`` and ``bands`` are keyed tables, the latter with a row for each band of each signature; ``state`` has
    (document_id, component, duplicate_of) of all documents so far, three numbers a document, and is
    published anew with each batch.  The grouping is that of ``deduplicate`` over all documents so far, with the copies known before.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.8):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.signatures = KeyedTable(spark, f"{self.path}/signatures", ["document_id"])
        self.bands = KeyedTable(spark, f"{self.path}/bands", ["band", "slots", "document_id"])

    def state(self, batches: list[str]) -> DataFrame | None:
        """The state after the last of the batches."""
        if not batches:
            return None
        held = Manifest(self.spark, f"{self.path}/state/{batches[-1]}.json").read()
        return self.spark.read.parquet(f"{self.path}/state/{held['data']}")

    def batches(self) -> list[str]:
        """The batches that count, in order."""
        names = []
        last = None
        while (found := Manifest(self.spark, f"{self.path}/state/after-{last or 'none'}.json").read()) is not None:
            last = found["batch"]
            names.append(last)
        return names

    def add(self, documents: DataFrame, batch: str) -> DataFrame:
        """Take in (document_id, body) and return the state: (document_id, component, duplicate_of) of all documents so far.

        A batch of a name that was taken in adds nothing; one that died is taken in anew.  Documents that are
        known already stay as they are, whatever their text.
        """
        before = self.batches()
        if batch in before:
            return self.state(before)
        old = self.state(before)
        texts = documents.select("document_id", "body").where("document_id IS NOT NULL").dropDuplicates(["document_id"])
        fresh = texts if old is None else texts.join(old.select("document_id"), "document_id", "left_anti")
        signed = cut(signatures(fresh))
        long = signed.where(F.col("shingles") >= MIN_SHINGLES)
        bands = _bands(long.select(F.col("document_id").alias("first"), "signature")).select("band", "slots", F.col("first").alias("document_id"))
        met = None
        if old is not None and (stored := self.bands.read()) is not None:
            keys = bands.select("band", "slots").distinct()
            touched = stored.join(keys, ["band", "slots"], "left_semi").select("document_id").distinct().join(old.select("document_id"), "document_id", "left_semi")
            met = self.signatures.read().join(touched, "document_id", "left_semi")
        links = near_links(signed if met is None else cut(signed.unionByName(met.select(*signed.columns))), self.threshold)
        state = cut(self._grouped(fresh.select("document_id"), old, links))
        self.signatures.insert(signed, batch)
        self.bands.insert(bands, batch)
        own = f"{batch}-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.path}/state/{own}")
        Manifest(self.spark, f"{self.path}/state/{batch}.json").put({"data": own})
        Manifest(self.spark, f"{self.path}/state/after-{before[-1] if before else 'none'}.json").put({"batch": batch})
        return self.state(self.batches())

    def _grouped(self, fresh: DataFrame, old: DataFrame | None, links: DataFrame) -> DataFrame:
        """The state with the new documents and links: components that were apart may become one."""
        none = fresh.select("document_id", F.col("document_id").alias("component"), F.lit(None).cast("long").alias("duplicate_of"))
        known = none if old is None else old.select("document_id", "component", "duplicate_of").unionByName(none)
        at = known.select("document_id", "component")
        ends = links.join(at.select(F.col("document_id").alias("a"), F.col("component").alias("x")), "a").join(at.select(F.col("document_id").alias("b"), F.col("component").alias("y")), "b")
        merged = connected_components(ends.select("x", "y"), "x", "y").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        wide = known.join(merged, "component", "left").select("document_id", F.coalesce("whole", "component").alias("component"), "duplicate_of")
        standing = known.where("duplicate_of IS NOT NULL").select(F.col("duplicate_of").alias("document_id")).distinct().withColumn("standing", F.lit(0))
        ranked = wide.join(standing, "document_id", "left")
        # a group's representative: the smallest that copies point at, else the smallest id
        chosen = ranked.groupBy("component").agg(F.min(F.struct(F.coalesce("standing", F.lit(1)), "document_id"))["document_id"].alias("chosen"))
        told = ranked.join(chosen, "component")
        new = F.when(F.col("standing").isNull() & (F.col("chosen") != F.col("document_id")), F.col("chosen"))
        return told.select("document_id", "component", F.coalesce("duplicate_of", new).alias("duplicate_of"))
