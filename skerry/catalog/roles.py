"""The driver's tables in the roles of domain tables.

Each role is one SELECT in the SQL that Spark and DuckDB share; ``{name}`` is a
table of the driver or an earlier role, and ``{A}`` makes an array.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables whose files hold what the name says.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ROLES = {
    # coded feed events: a root, a base and an event code, of which coarser ones repeat where no finer one applies
    "coded": """
        SELECT feed_event_id, document_id, occurred_at, place_id, root_code, base_code,
               CASE WHEN feed_event_id % 4 = 0 THEN base_code ELSE base_code || CAST(feed_event_id % 5 AS STRING) END AS event_code
        FROM (SELECT *, CASE WHEN feed_event_id % 17 = 0 THEN NULL ELSE root_code || CAST(feed_event_id % 3 AS STRING) END AS base_code
              FROM (SELECT event_id AS feed_event_id, user_id AS document_id, ts AS occurred_at, CAST(user_id % 25 AS INT) AS place_id,
                           lpad(CAST(1 + event_id % 20 AS STRING), 2, '0') AS root_code FROM {events}) a) b""",
    "links": """
        SELECT CAST(n_nationkey AS INT) AS concept_id, 'cameo' AS system, lpad(CAST(1 + n_nationkey % 20 AS STRING), 2, '0') || CAST(n_nationkey % 3 AS STRING) AS code,
               CAST(NULL AS INT) AS linked_run FROM {nation}
        UNION ALL SELECT CAST(n_nationkey AS INT), 'cameo', lpad(CAST(1 + (n_nationkey * 7) % 20 AS STRING), 2, '0'), 3 FROM {nation} WHERE n_nationkey % 5 = 0
        UNION ALL SELECT CAST(n_nationkey AS INT), 'cameo', lpad(CAST(1 + (n_nationkey * 3) % 20 AS STRING), 2, '0') || CAST(n_nationkey % 3 AS STRING) || CAST(n_nationkey % 5 AS STRING), 2 FROM {nation}
        UNION ALL SELECT CAST(n_nationkey AS INT), 'theme', 'T' || CAST(n_nationkey % 9 AS STRING), 2 FROM {nation}""",
    "articles": """
        SELECT doc_id AS document_id, text AS body, lang, source, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS published_on,
               {A}('T' || CAST(doc_id % 13 AS STRING), 'T' || CAST((doc_id * 7) % 17 AS STRING), 'TAX_' || CAST(doc_id % 4 AS STRING)) AS themes,
               {A}(CAST(doc_id % 25 AS INT), CAST((doc_id * 3) % 25 AS INT)) AS place_ids,
               CASE WHEN doc_id % 9 = 1 THEN doc_id - 1 END AS duplicate_of, doc_id % 11 = 3 AS is_junk FROM {documents}""",
    "places": "SELECT n_nationkey AS place_id, n_name AS place, n_regionkey AS region_id FROM {nation}",
    # a two-level hierarchy over the concepts 0 to 39, some with two parents
    "concepts": "SELECT DISTINCT CAST(p_partkey % 40 AS INT) AS concept_id FROM {part} UNION SELECT 100 + n_nationkey % 10 FROM {nation} UNION SELECT 200 + r_regionkey % 3 FROM {region}",
    "edges": """
        SELECT DISTINCT c AS child, p AS parent FROM (
          SELECT CAST(p_partkey % 40 AS INT) AS c, CAST(100 + p_partkey % 10 AS INT) AS p FROM {part}
          UNION ALL SELECT CAST(p_partkey % 40 AS INT), CAST(100 + (p_partkey % 40 * 7) % 10 AS INT) FROM {part} WHERE p_partkey % 40 % 3 = 0
          UNION ALL SELECT CAST(100 + n_nationkey % 10 AS INT), CAST(200 + n_nationkey % 10 % 3 AS INT) FROM {nation}) e""",
    # at the volume of lineitem: labels, verdicts of two runs, candidates and what was shown
    "pairs": """
        SELECT l_orderkey AS document_id, CAST(l_partkey % 40 AS INT) AS concept_id, max(l_quantity) AS quantity, min(l_linenumber) AS line,
               min(l_suppkey % 25) AS place_id FROM {lineitem} GROUP BY l_orderkey, CAST(l_partkey % 40 AS INT)""",
    "labels_all": """
        SELECT document_id, concept_id, quantity > 25 AS matched,
               CASE WHEN document_id % 7 = 0 THEN 'machine' WHEN document_id % 5 = 0 THEN 'adjudicated' WHEN document_id % 3 = 0 THEN 'imported' ELSE 'human' END AS source,
               document_id % 13 = 0 AS stale FROM {pairs} WHERE line <= 3""",
    "truth": "SELECT document_id, concept_id, matched FROM {labels_all} WHERE source IN ('human', 'adjudicated', 'imported') AND NOT stale",
    "verdicts": """
        SELECT run_id, document_id, concept_id, place_id,
               CASE WHEN (document_id + concept_id * run_id) % 19 = 0 THEN NULL ELSE quantity + (document_id * 7 + concept_id * run_id) % 15 - 7 > 25 END AS matched,
               CASE WHEN (document_id * 3 + concept_id + run_id) % 23 = 0 THEN 'timeout' END AS error,
               CASE WHEN document_id % 29 = 0 THEN NULL ELSE ((document_id * 31 + concept_id * 17 * run_id) % 101) / 100.0E0 END AS confidence,
               100 + document_id % 50 AS tokens, 0.5E0 + document_id % 4 AS seconds
        FROM {pairs}, (SELECT CAST(r_regionkey + 1 AS INT) AS run_id FROM {region} WHERE r_regionkey < 2) r WHERE line >= 2""",
    "pool": """
        SELECT *, rank <= 3 AND score >= 0.2 AS selected FROM (
          SELECT document_id, concept_id, score, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, concept_id) AS INT) AS rank
          FROM (SELECT document_id, concept_id, ((document_id * 13 + concept_id * 29) % 1000) / 1000.0E0 AS score FROM {pairs}) s) r""",
    "shown": "SELECT 1 AS run_id, document_id, concept_id FROM {pool} WHERE rank <= 4 UNION ALL SELECT 2, document_id, concept_id FROM {pool} WHERE rank % 2 = 1",
    # known events with windows; precursors and controls
    "calendar": """
        SELECT c_custkey AS entry_id, CASE c_custkey % 4 WHEN 0 THEN 'control' WHEN 1 THEN 'precursor' ELSE 'event' END AS kind,
               CAST(c_custkey % 25 AS INT) AS concept_id, c_nationkey AS place_id, DATE '2024-01-01' + CAST(c_custkey % 28 AS INT) AS starts_on,
               DATE '2024-01-01' + CAST(c_custkey % 28 + c_custkey % 3 AS INT) AS ends_on,
               CASE WHEN c_custkey % 4 = 1 THEN c_custkey + 1 END AS precursor_of FROM {customer}""",
    # quarter-hour slices of two feeds and how each ended
    "slices": """
        SELECT feed, slot, CASE WHEN slot % 97 = 5 THEN 'missing' WHEN slot % 101 = 7 THEN 'failed' WHEN n % 5 = 4 THEN 'empty' ELSE 'ok' END AS status, n AS events FROM (
          SELECT CASE WHEN event_id % 2 = 0 THEN 'export' ELSE 'gkg' END AS feed,
                 CAST(datediff({DAY}ts, DATE '2024-01-01') AS BIGINT) * 96 + CAST(floor((hour(ts) * 60 + minute(ts)) / 15) AS BIGINT) AS slot, count(*) AS n
          FROM {events} GROUP BY 1, 2) s""",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
}

_NAME = re.compile(r"\{(\w+)\}")


def needed(sql: str) -> list[str]:
    """The roles that ``sql`` uses, each after those it uses itself."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in ROLES:
            out += [x for x in [*needed(ROLES[name]), name] if x not in out]
    return out


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a role."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ROLES[name]
    used = {n: frame(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(sql)) if n in ROLES or n in TABLES}
    return spark.sql(sql.replace("{A}", "array").replace("{DAY}", ""), **used)


def duck(sql: str) -> str:
    """``sql`` over roles and tables for DuckDB: its roles become common tables."""

    def plain(text: str) -> str:
        text = text.replace("{A}", "list_value").replace("datediff({DAY}", "datediff('day', DATE '2024-01-01', ").replace(", ts, DATE '2024-01-01')", ", ts)")
        return _NAME.sub(lambda m: m[1] if m[1] in ROLES or m[1] in TABLES else m[0], text)

    roles = needed(sql)
    head = ", ".join(f"{name} AS ({plain(ROLES[name])})" for name in roles)
    if not roles:
        return plain(sql)
    body = plain(sql)
    return f"WITH {head}, {body.lstrip()[5:]}" if body.lstrip()[:5].upper() == "WITH " else f"WITH {head} {body}"


def _counted(sql: str) -> str:
    """``count_if(x)`` as a count of a CASE, which DuckDB gives as BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql


class Catalog:
    """Registered queries with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, roles: str, sql: str | None = None) -> Callable:
        """Register a function of the named frames."""

        def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(*(frame(spark, sf_dir, r) for r in roles.split()))

            query.__name__, query.__doc__ = name, f.__doc__
            self.queries[name] = query
            if sql:
                self.sql[name] = _counted(duck(sql))
            return f

        return keep
