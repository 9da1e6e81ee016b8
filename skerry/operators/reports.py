"""Comparisons of runs, evaluation of one run, and reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.rates import rate
from skerry.operators import metrics as M
from skerry.operators import sampling as S


def evaluate_run(truth: DataFrame, verdicts: DataFrame, pool: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: confusion with intervals, ranking, shown and liveness figures of a run (AGG43, AGG42)."""
    scored = M.with_intervals(M.confusion(M.answers(truth, verdicts)))
    live = M.liveness(verdicts).drop("run_id").withColumnRenamed("ok", "live")
    ranked = M.retrieval_metrics(truth, pool).withColumnRenamed("precision", "pool_precision").withColumnRenamed("coverage", "pool_coverage").drop("n_positives")
    seen = M.shown_metrics(truth, shown).select(*(F.col(c).alias(f"shown_{c}") for c in ("recall", "precision", "coverage")))
    return scored.crossJoin(ranked).crossJoin(seen).join(live, F.lit(True), "left")


def paired_bootstrap(truth: DataFrame, a: DataFrame, b: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """F1 of ``b`` minus F1 of ``a`` over the same resampled documents, with its interval (AGG19).

    Documents with equal counts in both runs are one cell; see ``sampling.resampled``.
    """
    def counted(verdicts: DataFrame, side: str) -> DataFrame:
        return S.document_counts(M.answers(truth, verdicts)).select("document_id", *(F.col(c).alias(f"{c}_{side}") for c in ("tp", "fp", "fn")))

    names = [f"{c}_{side}" for side in "ab" for c in ("tp", "fp", "fn")]
    cells = counted(a, "a").join(counted(b, "b"), "document_id").groupBy(*names).agg(F.count("*").alias("n"))

    def f1(side: str) -> Column:
        tp, fp, fn = (F.col(f"{c}_{side}") for c in ("tp", "fp", "fn"))
        return rate(2 * tp, 2 * tp + fp + fn)

    drawn = S.resampled(cells, names, replicates, seed).select((f1("b") - f1("a")).alias("d"))
    # one number a replicate
    ends = drawn.agg(F.array_sort(F.collect_list("d")).alias("d"))
    low, high = (F.round(F.get("d", F.floor(q * (F.size("d") - 1)).cast("int")), 4) for q in (0.025, 0.975))
    observed = cells.agg(F.sum("n").alias("documents"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in names))
    found = observed.select("documents", F.round(f1("b") - f1("a"), 6).alias("difference")).crossJoin(ends.select(low.alias("low"), high.alias("high")))
    return found.withColumn("improvement", F.coalesce(F.col("low") > 0, F.lit(False)))


def sample_status(scores: DataFrame, target: float = 0.05) -> DataFrame:
    """Whether the intervals are narrow enough to stop labelling (AGG39)."""
    widths = {f"{c}_half_width": F.round((F.col(f"{c}_high") - F.col(f"{c}_low")) / 2, 4) for c in ("precision", "recall")}
    out = scores.select("documents", (F.col("tp") + F.col("fn")).alias("positives"), *(w.alias(n) for n, w in widths.items()))
    met = (F.col("precision_half_width") <= target) & (F.col("recall_half_width") <= target)
    return out.withColumn("target_met", F.coalesce(met, F.lit(False)))


def compare_arms(truth: DataFrame, verdicts: DataFrame, baseline: int, arms: list[int]) -> DataFrame:
    """Each arm's scores beside its paired test against the baseline, one row an arm (EV01, EV02, EV03)."""
    out = None
    for arm in arms:
        own = verdicts.where(F.col("run_id") == arm)
        test = M.paired(truth, verdicts.where(F.col("run_id") == baseline), own).select("discordant", "statistic", "p_value")
        row = M.confusion(M.answers(truth, own)).crossJoin(test).withColumn("run_id", F.lit(arm))
        out = row if out is None else out.unionByName(row)
    return out


def regression(now: DataFrame, floors: dict[str, float], tolerance: float = 0.02) -> DataFrame:
    """pass, fail or inconclusive for each figure with a floor (AGG46, EV06)."""
    checks = [
        F.struct(
            F.lit(name).alias("figure"),
            F.col(name).alias("value"),
            F.when(F.col("n") == 0, "inconclusive").when(F.col(name) >= floor - tolerance, "pass").otherwise("fail").alias("gate"),
        )
        for name, floor in floors.items()
    ]
    return now.select(F.inline(F.array(*checks)))


def number(value: float | None, digits: int = 3) -> str:
    """A figure for people; a dash where there is none (FN27)."""
    return "-" if value is None else f"{value:.{digits}f}"


def interval(low: float | None, high: float | None, digits: int = 3) -> str:
    return "" if low is None or high is None else f"[{low:.{digits}f}, {high:.{digits}f}]"


def markdown(rows: DataFrame, columns: list[str], most: int = 200) -> str:
    """A report table as Markdown; for results of a few rows (SRC27).  Rows beyond ``most`` are counted in a last line."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    found = rows.select(*columns).take(most + 1)
    for row in found[:most]:
        cells = [number(v) if isinstance(v, float) or v is None else str(v).replace("|", "\\|") for v in row]
        lines.append("| " + " | ".join(cells) + " |")
    if len(found) > most:
        lines.append(f"\n{rows.count() - most} more rows are left out.")
    return "\n".join(lines) + "\n"


def code_outcomes(carried: DataFrame, members: DataFrame, seen: DataFrame) -> DataFrame:
    """Calendar entries and documents that each code reaches (AGG12, AGG14).

    ``carried``: document_id, system, code, once each; ``members``: entry_id, kind, window; ``seen``: window,
    document_id.  Each (entry_id, kind) has one window, so entries are counted by window before codes meet them.
    """
    documents = carried.join(seen.select("document_id").distinct(), "document_id", "left_semi").groupBy("system", "code").agg(F.count("document_id").alias("documents"))
    sizes = members.groupBy("window").agg(*(F.count(F.when(F.col("kind") == k, F.col("entry_id"))).alias(f"{k}s") for k in ("event", "control")))
    codes = carried.join(seen.select("window", "document_id"), "document_id").select("window", "system", "code").distinct()
    entries = codes.join(sizes, "window").groupBy("system", "code").agg(F.sum("events").alias("events"), F.sum("controls").alias("controls"))
    return documents.join(entries, ["system", "code"])


def share(part: DataFrame, whole: DataFrame) -> DataFrame:
    """One count of another (AGG01, AGG04)."""
    counts = part.agg(F.count("*").alias("part")).crossJoin(whole.agg(F.count("*").alias("whole")))
    return counts.withColumn("share", F.round(rate(F.col("part"), F.col("whole")), 6))


def live_leaderboard(truth: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every run's coverage of the sample and its scores; runs that cover only a part stay unscored (EV04, AGG44)."""
    sample = truth.select("document_id").distinct()
    size = sample.agg(F.count("*").alias("sample"))
    said = verdicts.join(sample, "document_id", "left_semi")
    covered = said.groupBy("run_id").agg(F.countDistinct("document_id").alias("covered"))
    positives = truth.agg(F.count_if("matched").alias("positives"))
    counts = M.clean(said).withColumnRenamed("matched", "predicted").join(truth, M.PAIR).groupBy("run_id").agg(
        F.count_if(F.col("predicted") & F.col("matched")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("matched")).alias("fp")
    )
    rows = covered.join(counts, "run_id", "left").fillna(0, ["tp", "fp"]).crossJoin(F.broadcast(size)).crossJoin(F.broadcast(positives))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("positives") - F.col("tp")
    f1 = F.when(F.col("covered") == F.col("sample"), F.round(rate(2 * tp, 2 * tp + fp + fn), 6))
    return rows.select("run_id", "sample", "covered", f1.alias("f1")).orderBy(F.desc_nulls_last("f1"), "run_id")
