"""Stratified orders, labelling queues and bootstrap intervals.

Randomness is a keyed hash of the row, so orders are the same on every run and
partition of the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.rates import rate
from skerry.operators.metrics import PAIR


#: Ranges into which a group is cut to be ranked.
PIECES = 1024


def draw(seed: int, key: str) -> Column:
    """A number in [0, 1) for each row: 52 bits of a digest, so that any engine can draw it again."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``_rank`` from 0 of each row in its group, and the group's ``_size``; order[0] lies in [0, 1).

    Ranks are taken within PIECES ranges of order[0], to which what lies before is
    added, so a group that holds most rows is spread over PIECES tasks.
    """
    pieces = rows.withColumn("_piece", F.floor(F.col(order[0]) * PIECES).cast("int"))
    whole = Window.partitionBy(*by)
    counts = pieces.groupBy(*by, "_piece").agg(F.count("*").alias("_n"))
    before = counts.select(
        *(F.col(c).alias(f"_of_{c}") for c in [*by, "_piece"]),
        (F.sum("_n").over(whole.orderBy("_piece")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_piece"]]
    inside = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order)) - 1
    return pieces.withColumn("_rank", inside).join(before, same).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*rows.columns, "_rank", "_size")


def _proportional(rows: DataFrame, key: str, by: list[str], seed: int) -> DataFrame:
    """``_at`` in [0, 1): by it every prefix of the rows holds all groups in proportion."""
    ranked = _ranked(rows.withColumn("_draw", draw(seed, key)), by, ["_draw", key])
    return ranked.withColumn("_at", (F.col("_rank") + draw(seed + 1, key)) / F.col("_size")).drop("_draw", "_rank", "_size")


def frozen_order(rows: DataFrame, key: str, stratum: list[str], seed: int = 0) -> DataFrame:
    """``position``: an order of which every prefix holds all strata in proportion (WIN05)."""
    return _positions(_proportional(rows, key, stratum, seed), ["_at", *stratum, key]).drop("_at")


def equal_order(rows: DataFrame, key: str, window: str, stratum: list[str], seed: int = 0) -> DataFrame:
    """As ``frozen_order`` within each window, the windows taking turns (WIN06)."""
    placed = _ranked(_proportional(rows, key, [window, *stratum], seed), [window], ["_at", *stratum, key])
    turns = placed.withColumn("_turn", F.col("_rank") + draw(seed + 2, key))
    return _positions(turns, ["_turn", window, key]).drop("_at", "_rank", "_size", "_turn")


#: How a sample is dealt over the windows.
ALLOCATIONS = ("equal-per-window", "proportional")


def draw_sample(frame: DataFrame, stratum: list[str], window: str = "window", key: str = "document_id", seed: int = 0, allocation: str = "equal-per-window") -> DataFrame:
    """The frozen order of a sample (OT35): by default each window has an equal share of every prefix."""
    if allocation not in ALLOCATIONS:
        raise ValueError(f"unknown allocation {allocation!r}; one of {ALLOCATIONS}")
    if allocation == "proportional":
        return frozen_order(frame, key, [window, *stratum], seed)
    return equal_order(frame, key, window, stratum, seed)


def sample_sheet(order: DataFrame, articles: DataFrame, start: int = 1, count: int = 120) -> DataFrame:
    """The documents at positions ``start`` and on of a frozen order, from 1, labelled or not, as people read them (OT12).

    ``order``: document_id, position from 0; ``articles``: document_id, body and, if
    known, title.  Without a title the body's first line stands in.
    """
    chosen = order.where(F.col("position").between(start - 1, start + count - 2)).select("document_id", (F.col("position") + 1).alias("position"))
    body = F.coalesce("body", F.lit(""))
    first_line = F.substring(F.substring_index(body, "\n", 1), 1, 160)
    title = F.coalesce(F.nullif("title", F.lit("")), first_line) if "title" in articles.columns else first_line
    excerpt = F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, 700)
    # a sheet has as many rows as a person reads
    return articles.join(chosen, "document_id").select("position", "document_id", title.alias("title"), excerpt.alias("excerpt"), F.lit("").alias("concepts"), F.lit("").alias("note"))


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Gapless global positions without one task that sorts everything: rank within ranges of the first key, plus what lies before.

    The ranges are PIECES below 1 and PIECES in each doubling above it.
    """
    first = F.col(order[0])
    spread = F.when(first < 1, F.floor(first * PIECES)).otherwise(PIECES + F.floor(F.log2(F.greatest(first, F.lit(1.0))) * PIECES))
    ranged = rows.withColumn("_range", spread.cast("int"))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    # PIECES rows for each doubling of the number of rows at most
    return ranged.join(F.broadcast(before), "_range").withColumn("position", F.col("_before") + inner).drop("_range", "_before")


def labelled_prefix(order: DataFrame, labelled: DataFrame, key: str = "document_id") -> DataFrame:
    """Which labelled documents lie in the longest fully labelled prefix (WIN07)."""
    marked = order.join(labelled.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    end = marked.agg(F.coalesce(F.min(F.when(F.col("_done").isNull(), F.col("position"))), F.max("position") + 1).alias("_end"))
    return marked.where("_done").crossJoin(F.broadcast(end)).select(key, "position", (F.col("position") < F.col("_end")).alias("in_prefix"))


def owned(sightings: DataFrame, order: str = "entry_id", key: str = "document_id") -> DataFrame:
    """The first window, in calendar order, that holds each document (WIN12)."""
    return sightings.groupBy(key).agg(F.min(order).alias(order))


def window_weights(order: DataFrame, labelled: DataFrame, window: str = "window", key: str = "document_id") -> DataFrame:
    """Frame size over labelled count of each labelled document's window (AGG38)."""
    sizes = order.groupBy(window).agg(F.count("*").alias("_size"))
    inside = order.select(key, window).join(labelled.select(key).distinct(), key, "left_semi")
    counts = inside.groupBy(window).agg(F.count("*").alias("_labelled"))
    return inside.join(sizes, window).join(counts, window).select(key, window, F.round(rate(F.col("_size"), F.col("_labelled")), 6).alias("weight"))


def queue(verdicts: DataFrame, selected: DataFrame, labels: DataFrame, usable_runs: DataFrame) -> DataFrame:
    """Priority of each pair for labelling, and why (BK06, OT05)."""
    clean = verdicts.where(F.col("error").isNull() & F.col("matched").isNotNull())
    informed = clean.join(usable_runs.withColumn("_usable", F.lit(True)), "run_id", "left")
    judged = informed.groupBy(*PAIR).agg(
        F.count("*").alias("judged"),
        F.min(F.col("matched").cast("int")).alias("_least"),
        F.max(F.col("matched").cast("int")).alias("_most"),
        F.avg(F.when(F.col("_usable"), F.col("confidence"))).alias("_mean"),
    )
    pairs = selected.select(*PAIR).distinct().join(judged, PAIR, "full")
    held = labels.groupBy("concept_id").agg(F.count("*").alias("_labels"))
    open_ = pairs.join(labels.select(*PAIR), PAIR, "left_anti").join(held, "concept_id", "left")
    coverage = 1.0 / (1 + F.coalesce("_labels", F.lit(0)))
    doubt = F.coalesce(F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.col("_mean") - 0.5)), F.lit(0.0))
    split, never = F.col("_least") != F.col("_most"), F.col("judged").isNull()
    score = F.when(split, 1 + doubt).when(never, 0.5 + 0.3 * coverage).when(doubt > 0, 0.4 * doubt + 0.2 * coverage).otherwise(0.1 * coverage)
    reason = F.when(split, "runs disagree").when(never, "never judged").when(doubt > 0, "model uncertain").otherwise("coverage")
    return open_.select(*PAIR, F.round(score + 1e-9, 6).alias("priority"), reason.alias("reason"))


def document_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp and fn of each document, the unit that is resampled."""
    m, p = F.col("matched"), F.col("predicted")
    return pairs.groupBy("document_id", *by).agg(F.count_if(m & p).alias("tp"), F.count_if(~m & p).alias("fp"), F.count_if(m & ~p).alias("fn"))


#: Cells that one task of a bootstrap draws.
CELLS = 4096


def resampled(cells: DataFrame, values: list[str], replicates: int, seed: int = 0, stratum: str | None = None) -> DataFrame:
    """(r, the values' totals) of each replicate: within each stratum, as many units as there are drawn with replacement.

    ``cells``: the values of units and ``n``, how many units have them; so a multinomial draw of
    the cells has the law of drawing units.  A stratum with more than CELLS cells is cut into parts.  A multinomial draw splits: how
    many units fall to each part is multinomial over the parts, and within a part its cells are again.  Each task works out
    the split from the stratum's seed and its parts' sizes, and draws its own cells; no task has all.
    """
    by = [F.col(stratum).cast("string").alias("_s") if stratum else F.lit("all").alias("_s")]
    named = cells.select(*by, "n", *values)
    parts = named.groupBy("_s").agg(F.ceil(F.count("*") / CELLS).cast("int").alias("_parts"))
    dealt = named.join(parts, "_s").withColumn("_part", F.pmod(F.xxhash64(*values), "_parts").cast("int"))
    sizes = dealt.groupBy("_s", "_part").agg(F.sum("n").alias("_size"))
    shares = sizes.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("_part", "_size"))).alias("_sizes"))
    # the sizes of a stratum's parts go with one row of each part, not with all
    first = shares.select(F.col("_s").alias("_of"), F.col("_sizes").alias("_split"), F.explode("_sizes._part").alias("_at"))

    def draw_part(key: tuple, own: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        stratum, part = key
        text = [seed, *map(ord, str(stratum))]
        sizes = [(x["_part"], x["_size"]) for x in split["_split"].iloc[0]]
        counts = np.array([n for _, n in sizes], np.int64)
        drawn = np.random.default_rng(text).multinomial(counts.sum(), counts / counts.sum(), replicates)[:, [p for p, _ in sizes].index(part)]
        ordered = own.sort_values(values)  # whatever the order of rows, the draws are the same
        n, rows = ordered["n"].to_numpy(), ordered[values].to_numpy()
        rng = np.random.default_rng([*text, part])
        totals = np.array([rng.multinomial(m, n / n.sum()) @ rows for m in drawn])
        return pd.DataFrame({"r": np.arange(replicates)} | {c: totals[:, i] for i, c in enumerate(values)})

    schema = ", ".join(["r int", *(f"{c} long" for c in values)])
    drawn = dealt.groupBy("_s", "_part").cogroup(first.groupBy("_of", "_at")).applyInPandas(draw_part, schema)
    return drawn.groupBy("r").agg(*(F.sum(c).alias(c) for c in values))


def bootstrap_scores(counts: DataFrame, replicates: int = 200, seed: int = 0, stratum: str | None = None) -> DataFrame:
    """Precision, recall and F1 with 95% intervals from resampling documents (AGG18, AGG20); strata of one document are pooled."""
    cells = counts.groupBy(*([stratum] if stratum else []), "tp", "fp", "fn").agg(F.count("*").alias("n"))
    if stratum:
        sizes = counts.groupBy(F.col(stratum).alias("_of")).agg(F.count("*").alias("_size"))
        cells = cells.join(sizes, F.col(stratum).eqNullSafe(F.col("_of")))
        cells = cells.withColumn("_s", F.when(F.col("_size") == 1, F.lit("singletons")).otherwise(F.concat(F.lit("s"), F.coalesce(F.col(stratum).cast("string"), F.lit("")))))
        cells = cells.groupBy("_s", "tp", "fp", "fn").agg(F.sum("n").alias("n"))
    drawn = resampled(cells, ["tp", "fp", "fn"], replicates, seed, "_s" if stratum else None)

    def scores(frame: DataFrame) -> DataFrame:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return frame.select(rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))

    names = ("precision", "recall", "f1")
    ends = scores(drawn).agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in names))

    def end(name: str, q: float) -> Column:
        return F.round(F.get(name, F.floor(q * (F.size(name) - 1)).cast("int")), 4)

    bounds = ends.select(*(end(c, q).alias(f"{c}_{side}") for c in names for side, q in (("low", 0.025), ("high", 0.975))))
    observed = counts.agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return observed.crossJoin(scores(observed).select(*(F.round(c, 6).alias(c) for c in names))).crossJoin(bounds)
