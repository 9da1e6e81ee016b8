"""Run configurations, stage keys, sweeps and snapshots; driver-side and small."""

from __future__ import annotations

import copy
import hashlib
import itertools
import json
from typing import Any

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.plans.shipping import ship

#: Settings that say where something runs, not what it computes; never part of a key (RN02).
INFRA = frozenset({"host", "url", "timeout", "retries", "workers", "batch_size", "api_key"})

STAGES = ("candidates", "retrieval", "judge")
#: How a judge may be asked; ``judging.MODES`` has what each does.
MODES = ("pair", "batch", "hierarchical", "extract")


def stable_hash(value: Any, size: int = 12) -> str:
    """The first digits of the SHA-256 of canonical JSON (FN26)."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:size]


def without_infra(config: Any) -> Any:
    if isinstance(config, dict):
        return {k: without_infra(v) for k, v in config.items() if k not in INFRA}
    return [without_infra(v) for v in config] if isinstance(config, list) else config


def normalised(config: dict) -> dict:
    """A configuration with its defaults; unknown stages are refused (SRC23)."""
    if unknown := set(config) - {"name", *STAGES, "ontology", "documents"}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    base = {
        "candidates": {"model": "hash", "pool_size": 20, "cutoff": {"min_score": 0.25, "margin": 0.1, "max_k": 15}},
        "retrieval": {"strategy": "flat"},
        "judge": {"model": "hash", "mode": "pair", "samples": 1, "vote": "majority"},
        "ontology": "latest",
        "documents": {},
    }
    merged = deep_merge(base, {k: v for k, v in config.items() if k != "name"})
    if merged["judge"]["samples"] < 1 or merged["candidates"]["pool_size"] < 1:
        raise ValueError("samples and pool_size have to be 1 or more")
    if merged["judge"]["vote"] not in ("majority", "unanimous", "any"):
        raise ValueError(f"unknown vote {merged['judge']['vote']!r}")
    if merged["judge"]["mode"] not in MODES:
        raise ValueError(f"unknown mode {merged['judge']['mode']!r}; one of {MODES}")
    return merged


def deep_merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def stage_keys(config: dict) -> dict[str, str]:
    """A key for each stage that also covers the stages before it (RN01): equal keys mean equal results."""
    clean, keys, before = without_infra(normalised(config)), {}, stable_hash([config.get("ontology", "latest"), config.get("documents", {})])
    for stage in STAGES:
        before = keys[stage] = stable_hash([before, stage, clean[stage]])
    return keys


def sweep(base: dict, axes: dict[str, list]) -> list[dict]:
    """All combinations of dotted settings, merged into the base (RN05)."""
    out = []
    for values in itertools.product(*axes.values()):
        config = copy.deepcopy(base)
        for path, value in zip(axes, values, strict=True):
            at = config
            *way, last = path.split(".")
            for step in way:
                at = at.setdefault(step, {})
            at[last] = value
        out.append(config)
    return out


def stable_hashes(value: Column, size: int = 12) -> Column:
    """``stable_hash`` of each row's JSON (FN26); null where it is none."""

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else stable_hash(json.loads(text), size)
            except ValueError:
                return None

        return texts.map(one)

    return hashed(value)


def judge_keys(config: Column) -> Column:
    """The judge's key of each row's configuration in JSON, null where it is none (RN01)."""

    @F.pandas_udf("string")
    def keyed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return stage_keys(json.loads(text))["judge"] if text else None
            except (ValueError, TypeError):
                return None

        return texts.map(one)

    return keyed(config)


def sweep_status(history: DataFrame, base: dict, axes: dict[str, list]) -> DataFrame:
    """(setting, candidates_key, run_id): each run of a sweep with the first run of the history that did it, null if it is to be done (RN05).

    ``history``: run_id, config (JSON), status; a run counts if its status is ``done``, whatever it ran on.
    """
    ship(history.sparkSession)
    rows = []
    for values, config in zip(itertools.product(*axes.values()), sweep(base, axes), strict=True):
        keys = stage_keys(config)
        rows.append(("/".join(map(str, values)), keys["candidates"], keys["judge"]))
    # the product of a sweep's settings is as many runs as someone pays for
    planned = F.broadcast(history.sparkSession.createDataFrame(rows, "setting string, candidates_key string, judge_key string"))
    done = history.where("status = 'done'").select("run_id", judge_keys(F.col("config")).alias("judge_key")).groupBy("judge_key").agg(F.min("run_id").alias("run_id"))
    return planned.join(done, "judge_key", "left").select("setting", "candidates_key", "run_id")


def source_chain(run: int, sources: dict[int, int | None]) -> list[int]:
    """A run and the runs it took its results from, stopping at a cycle (OT10)."""
    out: list[int] = []
    while run is not None and run not in out:
        out.append(run)
        run = sources.get(run)
    return out


def wording(*columns: str) -> Column:
    """A concept's wording without differences in case or blanks at the ends."""
    return F.concat_ws("\u001f", *(F.trim(F.coalesce(F.col(c), F.lit(""))) for c in columns))


def snapshot_hash(concepts: DataFrame, columns: tuple[str, ...] = ("name", "definition")) -> DataFrame:
    """One hash of the whole wording, whatever the order of rows (ON02): sums of the rows' digests, so no row goes to the driver or one task."""
    digest = F.sha2(F.concat_ws("\u001e", F.col("concept_id").cast("string"), wording(*columns)), 256)
    sums = concepts.select(digest.alias("_d")).agg(*(F.sum(F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long")).cast("string").alias(f"_{i}") for i in range(8)))
    return sums.select(F.substring(F.sha2(F.concat_ws(",", *sums.columns), 256), 1, 16).alias("content_hash"))


def stale_concepts(then: DataFrame, now: DataFrame, columns: tuple[str, ...] = ("name", "definition")) -> DataFrame:
    """Classes reworded or gone since a snapshot (ON04, JN24)."""
    old = then.select("concept_id", wording(*columns).alias("_then"))
    new = now.select("concept_id", wording(*columns).alias("_now"))
    return old.join(new, "concept_id", "left").where(~F.col("_then").eqNullSafe(F.col("_now"))).select("concept_id")


def retrieval_version(config: dict, leaves: list[tuple[int, str]]) -> str:
    """Names how leaves are ranked: the settings and the leaves with their wording, in any order (RN06)."""
    clean = without_infra(normalised(config))
    return stable_hash([clean["candidates"], clean["retrieval"], sorted(leaves)])


def judge_version(config: dict, prompts: dict[str, str]) -> str:
    """Names how pairs are judged: the settings and the wording of the prompts (RN06)."""
    return stable_hash([without_infra(normalised(config))["judge"], prompts])


def filter_version(links: list[tuple[int, str, str]]) -> str:
    """Names what a feed is filtered by (RN06)."""
    return stable_hash(sorted(links))


def source_fingerprint(*functions) -> str:
    """Changes when the code of the functions does (RN07)."""
    import inspect

    return stable_hash([inspect.getsource(f) for f in functions])


class DriftError(ValueError):
    """Prompts aren't those that a run was pinned to."""


def check_prompts(pinned: dict[str, str], prompts: dict[str, str]) -> None:
    """Refuse prompts whose wording drifted from the pins, name -> hash (JD07)."""
    drifted = sorted(name for name, pin in pinned.items() if stable_hash(prompts.get(name)) != pin)
    if drifted:
        raise DriftError(f"reworded since the run was pinned: {drifted}")


def own_cutoff(config: dict) -> dict:
    """The cutoff a run was made with (OT16)."""
    return normalised(config)["candidates"]["cutoff"]


def judging_copy(config: dict, **judge) -> dict:
    """A stored configuration with another decoder (OT27)."""
    return deep_merge(config, {"judge": judge})


def reopened(record: dict) -> dict:
    """A run's record open again: its start stays, its end and error go (OT36)."""
    return record | {"finished_at": None, "error": None}
