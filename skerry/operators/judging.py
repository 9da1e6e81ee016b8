"""Asking a model about documents and classes, and keeping what it says.

Four modes, by which a run is configured: each pair by itself, all classes of a
document in one call, down the hierarchy, or by the events of the article, each of which
gets one class at most.  Whoever asks goes through ``providers.asked``, so
each prompt is asked once, and failed calls are rows with an error.  What has a
verdict is left out by an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import prompts as P
from skerry.functions import replies
from skerry.operators import hierarchy
from skerry.operators.metrics import PAIR, voted
from skerry.operators.providers import ChatProvider, EmbeddingProvider, HashChat, HashEmbedder, Patience, asked, embedded
from skerry.operators.ranking import split_remainder
from skerry.plans.cuts import cut

__all__ = ["ChatProvider", "EmbeddingProvider", "HashChat", "HashEmbedder", "Patience", "asked", "embedded"]

UNREADABLE = "unreadable reply"


def article_text(articles: DataFrame, limit: int | None = None) -> Column:
    """What a prompt says of an article: its address and title where the table has them, and its body."""
    url, title = (F.col(c) if c in articles.columns else F.lit(None).cast("string") for c in ("url", "title"))
    return P.article(url, title, F.col("body"), limit)


def class_struct(concepts: DataFrame) -> Column:
    """A class as prompts take it; what the table doesn't have is null."""
    parts = [F.col(c) if c in concepts.columns else F.lit(None).cast("string").alias(c) for c in ("name", "definition", "inclusion", "exclusion")]
    return F.struct(F.col("concept_id").cast("int").alias("concept_id"), *parts)


def _classes(concepts: DataFrame) -> DataFrame:
    return concepts.select(F.col("concept_id").cast("int").alias("concept_id"), class_struct(concepts).alias("class"))


def _failure(reply: Column, read: Column) -> Column:
    """The call's error, or that its reply can't be read."""
    return F.coalesce(F.col("error"), F.when(reply.isNull() | ~F.coalesce(read, F.lit(False)), UNREADABLE))


def pending(pairs: DataFrame, done: DataFrame, key: list[str] = PAIR) -> DataFrame:
    """Pairs that have no verdict yet (JD01, ST17)."""
    return pairs.join(done.select(*key), key, "left_anti")


def first_pairs(pairs: DataFrame, limit: int | None, by_score: bool) -> DataFrame:
    """The pairs to judge now (JD01): in the order of ids or, by score, best first; all without a limit."""
    if limit is None:
        return pairs
    return pairs.orderBy(*([F.desc("score")] if by_score else []), *PAIR).limit(limit)


def _verdicts(rows: DataFrame) -> DataFrame:
    """Null answers where there is an error."""
    ok = F.col("error").isNull()
    return rows.select("document_id", F.col("concept_id").cast("int").alias("concept_id"), F.when(ok, F.col("matched")).alias("matched"), F.when(ok, F.col("confidence")).alias("confidence"), "error")


def _failed(rows: DataFrame, error: str | Column) -> DataFrame:
    said = F.lit(error) if isinstance(error, str) else error
    return _verdicts(rows.select(*PAIR, F.lit(None).cast("boolean").alias("matched"), F.lit(None).cast("double").alias("confidence"), said.alias("error")))


def judge(
    pairs: DataFrame, articles: DataFrame, concepts: DataFrame, done: DataFrame, provider: ChatProvider, samples: int = 1, vote: str = "majority",
    limit: int | None = None, by_score: bool = False, log: str | None = None, patience: Patience = Patience(), body_limit: int | None = None, concept_first: bool = False,
) -> DataFrame:
    """Verdicts of the pairs not yet judged (JD01, JD02), by vote where several samples are drawn.

    A sample that failed or can't be read has no vote; a pair without any is an error.
    The confidence is that of the sample that first gave the answer, with several
    samples the share that gave it.  A document without a body is an error row and
    stays in the count (JD06).
    """
    wanted = first_pairs(pending(pairs, done), limit, by_score).select("document_id", F.col("concept_id").cast("int").alias("concept_id"))
    # texts are shuffled once: the article is written behind the join, and missing bodies are found without the others
    told = articles.select("document_id", *(c for c in ("url", "title", "body") if c in articles.columns)).where("body IS NOT NULL")
    with_text = wanted.join(told, "document_id").join(_classes(concepts), "concept_id")
    empty = articles.select("document_id", F.col("body").isNull().alias("empty"))
    without = wanted.join(empty, "document_id", "left").where("coalesce(empty, true)").join(_classes(concepts).select("concept_id"), "concept_id")
    text = (P.concept_first if concept_first else P.pair)(article_text(told, body_limit), F.col("class"))
    prompts = with_text.select(*PAIR, text.alias("prompt"))
    if samples == 1:
        answers = asked(prompts, provider, log=log, patience=patience).select(*PAIR, replies.verdict(F.col("reply")).alias("v"), "reply", "error")
        verdicts = answers.select(*PAIR, "v.matched", "v.confidence", _failure(F.col("reply"), F.col("v.matched").isNotNull()).alias("error"))
    else:
        said = asked(prompts, provider, log=log, patience=patience, samples=samples).select(*PAIR, "sample", replies.verdict(F.col("reply"))["matched"].alias("matched"))
        votes = voted(said.where("matched IS NOT NULL"), PAIR, vote).select(*PAIR, "matched", F.col("vote_fraction").alias("confidence"))
        missed = F.when(F.col("matched").isNull(), F.lit("no sample could be read")).alias("error")
        verdicts = prompts.select(*PAIR).join(votes, PAIR, "left").select(*PAIR, "matched", "confidence", missed)
    return _verdicts(verdicts).unionByName(_failed(without, "no body"))


def _asked_together(sets: DataFrame, provider: ChatProvider, routing: bool, log: str | None, patience: Patience) -> DataFrame:
    """Verdicts of (document_id, article, classes), one call a row.

    A class the reply leaves out is a no; a failed or unreadable call is an error of all its classes.
    """
    build = P.route if routing else P.batch
    ids = F.transform("classes", lambda c: c["concept_id"])
    calls = asked(sets.select("document_id", ids.alias("ids"), build(F.col("article"), F.col("classes")).alias("prompt")), provider, log=log, patience=patience)
    failure = _failure(F.col("reply"), replies.listed(F.col("reply")))
    read = calls.select("document_id", failure.alias("error"), F.explode(replies.batch(F.coalesce("reply", F.lit("")), F.col("ids"))).alias("r"))
    return _verdicts(read.select("document_id", "r.concept_id", "r.matched", "r.confidence", "error"))


def _gathered(pairs: DataFrame, concepts: DataFrame, by: list[str]) -> DataFrame:
    """The classes of each document (and set), in the order of their ids: those it is shown, so they fit into a row."""
    named = pairs.select(*by, F.col("concept_id").cast("int").alias("concept_id")).join(_classes(concepts), "concept_id")
    return named.groupBy(*by).agg(F.array_sort(F.collect_list("class")).alias("classes"))


def judge_batched(
    pairs: DataFrame, articles: DataFrame, concepts: DataFrame, done: DataFrame, provider: ChatProvider, log: str | None = None, patience: Patience = Patience(), body_limit: int | None = None
) -> DataFrame:
    """Verdicts by one call a document (JD03); a failed call is recorded on every pair of the document."""
    known = _gathered(pending(pairs.select(*PAIR), done), concepts, ["document_id"]).join(
        articles.select("document_id", "body", article_text(articles, body_limit).alias("article")), "document_id", "left"
    )
    missing = known.where("body IS NULL").select("document_id", F.explode(F.transform("classes", lambda c: c["concept_id"])).alias("concept_id"))
    return _asked_together(known.where("body IS NOT NULL"), provider, False, log, patience).unionByName(_failed(missing, "no body"))


def _gate(pairs: DataFrame, articles: DataFrame, body_limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Documents that retrieval chose a class for, with a body and without."""
    chosen = pairs.select("document_id").distinct().join(articles.select("document_id", "body", article_text(articles, body_limit).alias("article")), "document_id", "left")
    return chosen.where("body IS NOT NULL").select("document_id", "article"), chosen.where("body IS NULL").select("document_id")


def _top(edges: DataFrame) -> DataFrame:
    """The top classes as one row with an array; a hierarchy's top is a handful."""
    return hierarchy.top_level(edges).agg(F.array_sort(F.collect_list(F.col("concept_id").cast("int"))).alias("top"))


def routing(documents: DataFrame, concepts: DataFrame, edges: DataFrame, provider: ChatProvider, log: str | None = None, patience: Patience = Patience()) -> tuple[DataFrame, DataFrame]:
    """(answers, offers) of going down the hierarchy (RT08): verdicts of the parent classes, and (document_id, under, concept_id) of the leaves reached.

    ``documents``: document_id, article.  In each round the parents of each set of siblings are asked in one call.  Each
    class is in one set of a document, under its first parent answered yes; nothing is offered below a failed call.
    """
    links = edges.select(F.col("child").cast("int").alias("child"), F.col("parent").cast("int").alias("parent")).distinct()
    parents = links.select(F.col("parent").alias("concept_id")).distinct()
    # one row
    ask = cut(documents.select("document_id").crossJoin(F.broadcast(_top(links))).select("document_id", F.lit(-1).alias("under"), F.explode("top").alias("concept_id")))
    placed, answers, offers = ask.where("false"), None, None
    while not ask.isEmpty():
        questions, leaves = ask.join(parents, "concept_id", "left_semi"), ask.join(parents, "concept_id", "left_anti")
        sets = _gathered(questions, concepts, ["document_id", "under"]).join(documents, "document_id")
        said = cut(_asked_together(sets, provider, True, log, patience))
        answers = said if answers is None else answers.unionByName(said)
        offers = leaves if offers is None else offers.unionByName(leaves)
        placed = cut(placed.unionByName(ask))
        below = said.where("matched").join(links, F.col("concept_id") == F.col("parent")).groupBy("document_id", F.col("child").alias("concept_id")).agg(F.min("parent").alias("under"))
        ask = cut(below.join(placed, PAIR, "left_anti").select("document_id", "under", "concept_id"))
    if answers is None:
        return _failed(ask, "no body"), ask
    return answers, offers.select("document_id", "under", "concept_id")


def judge_hierarchical(
    pairs: DataFrame, articles: DataFrame, concepts: DataFrame, done: DataFrame, provider: ChatProvider, edges: DataFrame,
    log: str | None = None, patience: Patience = Patience(), body_limit: int | None = None,
) -> DataFrame:
    """Verdicts down the hierarchy (JD04): the parents' routing answers, and one deciding call for each set of leaves reached.

    Leaves that nothing led to have no row.  Give the log of an interrupted run, and what it asked isn't asked again.
    """
    documents, empty = _gate(pairs, articles, body_limit)
    answers, offers = routing(documents, concepts, edges, provider, log, patience)
    decided = _asked_together(_gathered(offers, concepts, ["document_id", "under"]).join(documents, "document_id"), provider, False, log, patience)
    missing = empty.crossJoin(F.broadcast(_top(edges))).select("document_id", F.explode("top").alias("concept_id"))
    return pending(answers.unionByName(decided).unionByName(_failed(missing, "no body")), done)


def extracted_events(documents: DataFrame, concepts: DataFrame, edges: DataFrame, provider: ChatProvider, log: str | None = None, patience: Patience = Patience()) -> tuple[DataFrame, DataFrame]:
    """(events, failures) of documents (document_id, article): (document_id, ordinal, event) and (document_id, error)."""
    top = _gathered(hierarchy.top_level(edges).withColumn("all", F.lit(0)), concepts, ["all"]).select("classes")
    calls = asked(documents.crossJoin(F.broadcast(top)).select("document_id", P.extract(F.col("article"), F.col("classes")).alias("prompt")), provider, log=log, patience=patience)
    failure = _failure(F.col("reply"), replies.has_events(F.col("reply")))
    read = cut(calls.select("document_id", failure.alias("error"), replies.event_list(F.coalesce("reply", F.lit(""))).alias("events")))
    return read.where("error IS NULL").select("document_id", F.posexplode("events").alias("ordinal", "event")), read.where("error IS NOT NULL").select("document_id", F.concat(F.lit("event extraction failed: "), "error").alias("error"))


def routed_events(events: DataFrame, concepts: DataFrame, edges: DataFrame, provider: ChatProvider, log: str | None = None, patience: Patience = Patience()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passed, reached, failures) of events going down the hierarchy by themselves (RT09).

    ``passed``: the parents each event was asked about, with its answer; ``reached``: the leaves it came to.
    At the top all classes are asked about, and none of them may be the answer.  Below, the leaves
    under a parent answered yes are reached as they are, its parents are asked about again.
    A failed call costs its own event only.
    """
    key = ["document_id", "ordinal"]
    links = edges.select(F.col("child").cast("int").alias("child"), F.col("parent").cast("int").alias("parent")).distinct()
    parents = links.select(F.col("parent").alias("concept_id")).distinct()
    frontier = cut(events.select(*key).crossJoin(F.broadcast(_top(links))).select(*key, F.explode("top").alias("concept_id")))
    seen, passed, reached, failed, first = frontier, [], [], [], True
    while first or not frontier.isEmpty():
        ask = frontier if first else frontier.join(parents, "concept_id", "left_semi")
        if not first:
            reached.append(frontier.join(parents, "concept_id", "left_anti").select(*key, "concept_id"))
        sets = _gathered(ask, concepts, key).join(events, key)
        ids = F.transform("classes", lambda c: c["concept_id"])
        calls = asked(sets.select(*key, ids.alias("ids"), P.event_route(_event(F.col("event")), F.col("classes"), other=first).alias("prompt")), provider, log=log, patience=patience)
        yes = replies.choices(F.coalesce("reply", F.lit("")), F.col("ids"))
        read = cut(calls.select(*key, "ids", yes.alias("yes"), _failure(F.col("reply"), yes.isNotNull()).alias("error")))
        failed.append(read.where("error IS NOT NULL").select(*key, "error"))
        said = read.where("error IS NULL").select(*key, "yes", F.explode("ids").alias("concept_id")).select(*key, "concept_id", F.array_contains("yes", F.col("concept_id")).alias("matched"))
        passed.append(said.join(parents, "concept_id", "left_semi").select(*key, "concept_id", "matched"))
        reached.append(said.where("matched").join(parents, "concept_id", "left_anti").select(*key, "concept_id"))
        below = said.where("matched").join(links, F.col("concept_id") == F.col("parent")).select(*key, F.col("child").alias("concept_id")).distinct()
        frontier, first = cut(below.join(seen, [*key, "concept_id"], "left_anti")), False
        seen = cut(seen.unionByName(frontier))
    union = lambda parts: cut(_all(parts).distinct())
    return union(passed), union(reached), union(failed)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _event(e: Column) -> Column:
    """An event as prompts take it."""
    return F.struct(e["what"].alias("what"), e["status"].alias("status"), e["country"].alias("country"), F.lit(None).cast("string").alias("evidence"))


OUTCOMES = ("classified", "unclassified", "rejected", "error")


def assigned_events(
    pairs: DataFrame, articles: DataFrame, concepts: DataFrame, provider: ChatProvider, edges: DataFrame, log: str | None = None, patience: Patience = Patience(), body_limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, events) of judging by events (JD05): each event of a document gets one leaf at most.

    An event is ``rejected`` if it reached no leaf, ``error`` if one of its calls failed, else it was offered the
    leaves it reached and is ``classified`` or ``unclassified``.  A document's verdicts follow: a parent is a yes if any
    event passed it, an offered leaf if any event chose it, with the confidence of the surest; a document none of whose events
    was answered about anything is a no for each top class, one whose events couldn't be read an error for each.
    """
    key = ["document_id", "ordinal"]
    documents, empty = _gate(pairs, articles, body_limit)
    events, unread = extracted_events(documents, concepts, edges, provider, log, patience)
    passed, reached, lost = routed_events(events, concepts, edges, provider, log, patience)
    lost = lost.groupBy(*key).agg(F.min("error").alias("lost"))
    offered = cut(reached.join(lost, key, "left_anti"))
    sets = _gathered(offered, concepts, key).join(events, key)
    ids = F.transform("classes", lambda c: c["concept_id"])
    calls = asked(sets.select(*key, ids.alias("ids"), P.choose(_event(F.col("event")), F.col("classes")).alias("prompt")), provider, log=log, patience=patience)
    choice = replies.chosen(F.coalesce("reply", F.lit("")), F.col("ids"))
    chosen = cut(calls.select(*key, choice.alias("c"), _failure(F.col("reply"), choice.isNotNull()).alias("error")).select(*key, "c.concept_id", "c.confidence", "error", F.lit(True).alias("offered")))
    through = passed.where("matched").groupBy(*key).agg(F.array_sort(F.collect_set("concept_id")).alias("routed_through"))
    told = events.join(chosen, key, "left").join(lost, key, "left").join(through, key, "left")
    error = F.coalesce("lost", "error")
    outcome = F.when(error.isNotNull(), "error").when(F.col("offered").isNull(), "rejected").when(F.col("concept_id").isNotNull(), "classified").otherwise("unclassified")
    out = told.select(*key, "event.what", "event.status", "event.country", "concept_id", "confidence", F.coalesce("routed_through", F.array().cast("array<int>")).alias("routed_through"), outcome.alias("outcome"), error.alias("error"))

    asked_parents = passed.groupBy(*PAIR).agg(F.bool_or("matched").alias("matched")).withColumn("confidence", F.lit(None).cast("double"))
    picks = chosen.where("concept_id IS NOT NULL").groupBy(*PAIR).agg(F.max("confidence").alias("confidence")).withColumn("matched", F.lit(True))
    leaves = offered.select(*PAIR).distinct().join(picks, PAIR, "left").select(*PAIR, F.coalesce("matched", F.lit(False)).alias("matched"), "confidence")
    rows = cut(asked_parents.select(*PAIR, "matched", "confidence").unionByName(leaves).withColumn("error", F.lit(None).cast("string")))
    # one row
    top = F.broadcast(_top(edges))
    bare = documents.select("document_id").join(unread, "document_id", "left_anti").join(rows.select("document_id"), "document_id", "left_anti")
    none = bare.crossJoin(top).select("document_id", F.explode("top").alias("concept_id"), F.lit(False).alias("matched"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"))
    failed = unread.unionByName(empty.withColumn("error", F.lit("no body"))).crossJoin(top).select("document_id", F.explode("top").alias("concept_id"), "error")
    return _verdicts(rows.unionByName(none)).unionByName(_failed(failed, F.col("error"))), out


def judge_extract(
    pairs: DataFrame, articles: DataFrame, concepts: DataFrame, done: DataFrame, provider: ChatProvider, edges: DataFrame,
    log: str | None = None, patience: Patience = Patience(), body_limit: int | None = None,
) -> DataFrame:
    """Verdicts by events (JD05); documents that have verdicts are left out."""
    fresh = pairs.join(done.select("document_id").distinct(), "document_id", "left_anti")
    return assigned_events(fresh, articles, concepts, provider, edges, log, patience, body_limit)[0]


def trial(pairs: DataFrame, articles: DataFrame, concepts: DataFrame, provider: ChatProvider, samples: int = 1, vote: str = "majority", log: str | None = None) -> DataFrame:
    """What a judge would say of pairs; no verdict is stored (JD08)."""
    return judge(pairs, articles, concepts, pairs.where("false"), provider, samples, vote, log=log)


#: By the mode of a run's settings.  Those down the hierarchy also take ``edges``.
MODES = {"pair": judge, "batch": judge_batched, "hierarchical": judge_hierarchical, "extract": judge_extract}


def judged(mode: str, pairs: DataFrame, articles: DataFrame, concepts: DataFrame, done: DataFrame, provider: ChatProvider, **how) -> DataFrame:
    """Verdicts by the mode a run is configured with (JD01)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {sorted(MODES)}")
    return MODES[mode](pairs, articles, concepts, done, provider, **how)


def batched_cost(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """A call's tokens split exactly over its pairs, the first taking the remainder (JD03)."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id")
    placed = pairs.withColumn("_at", F.row_number().over(w.orderBy("concept_id")) - 1).withColumn("_of", F.count("*").over(w))
    shared = placed.join(calls, "document_id")
    return shared.select(*PAIR, split_remainder(F.col("tokens"), F.col("_of"), F.col("_at")).alias("tokens"))


def best_event(rows: DataFrame) -> DataFrame:
    """The most confident event of each document and leaf (JD05)."""
    return rows.groupBy(*PAIR).agg(F.max_by("ordinal", F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("ordinal"))).alias("ordinal"))


def missing_vectors(objects: DataFrame, cache: DataFrame, key: list[str] = ["object_id", "text_key"]) -> DataFrame:  # noqa: B006
    """Objects whose text isn't embedded yet (RT01)."""
    return objects.join(cache.select(*key), key, "left_anti")
