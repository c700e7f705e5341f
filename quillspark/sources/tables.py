"""The bundle of tables that the queries read, and its build from the star-schema test tables."""

from __future__ import annotations

import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables as SQL over the given ones; {NTZ} is TIMESTAMP_NTZ in Spark and TIMESTAMP in DuckDB.
VIEWS = {
    "sources": """
SELECT CAST(substr(source, 4) AS INT) AS id, source AS name,
       CASE WHEN CAST(substr(source, 4) AS INT) % 5 = 4 THEN 'Weekly' ELSE 'Daily' END AS cadence
  FROM (SELECT DISTINCT source FROM {documents}) s""",
    "documents": """
SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS INT) AS source_id, d.lang AS language,
       concat('https://', d.source, '.example.com/articles/', CAST(d.doc_id AS STRING), '?utm=', CAST(d.doc_id % 7 AS STRING)) AS url,
       concat('https://', d.source, '.example.com/articles/', CAST(d.doc_id AS STRING)) AS canonical_url,
       substr(d.text, 1, 60) AS title,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE concat('author', CAST(d.doc_id % 9 AS STRING)) END AS author,
       CAST('2024-01-01 00:00:00' AS {NTZ}) + ((d.doc_id * 997) % 43200) * INTERVAL '1' MINUTE AS published_at,
       d.text AS content,
       CASE WHEN l.toxic = 1 THEN 'wrong_body' WHEN l.quality = 0 THEN 'thin' END AS flag_reason,
       CASE WHEN (l.toxic = 1 OR l.quality = 0) AND d.doc_id % 2 = 0 THEN concat('detail ', CAST(d.doc_id AS STRING)) END AS flag_detail,
       CASE WHEN l.toxic = 1 OR l.quality = 0 THEN CAST('2024-02-01 00:00:00' AS {NTZ}) + (d.doc_id % 1440) * INTERVAL '1' MINUTE END AS flagged_at,
       CASE WHEN (l.toxic = 1 OR l.quality = 0) AND d.doc_id % 3 = 0 THEN 'agent' END AS flagged_by
  FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "importance": """
SELECT e.event_id AS id, e.event_id % (SELECT count(*) FROM {documents}) AS document_id, least(e.value / 100.0, 1.0) AS score,
       CASE e.user_id % 3 WHEN 0 THEN 'jev' WHEN 1 THEN 'agent' END AS reporter,
       CASE WHEN e.event_id % 4 <> 1 THEN concat('reason ', CAST(e.event_id AS STRING)) END AS rationale, e.ts AS created_at
  FROM {events} e
 WHERE e.event_type IN ('purchase', 'signup') AND e.event_id % 7 <> 3""",
    "topics": """
SELECT e.event_id AS id, e.event_id % (SELECT count(*) FROM {documents}) AS document_id,
       CASE e.user_id % 8 WHEN 0 THEN 'ai' WHEN 1 THEN 'jewelry' WHEN 2 THEN 'luxury' WHEN 3 THEN 'mexico'
            WHEN 4 THEN 'brazil' WHEN 5 THEN 'report' WHEN 6 THEN 'news' ELSE 'gen-z' END AS topic_slug,
       e.event_id % 4 <> 0 AS assigned,
       CASE WHEN e.user_id % 2 = 0 THEN 'jev' END AS reporter, e.ts AS created_at
  FROM {events} e
 WHERE e.event_type = 'click'""",
    "reads": """
SELECT e.event_id % (SELECT count(*) FROM {documents}) AS document_id, concat('reader', CAST(e.user_id % 10 AS STRING)) AS reader, max(e.ts) AS read_at
  FROM {events} e
 WHERE e.event_type = 'view' GROUP BY 1, 2""",
    "runs": """
SELECT e.event_id AS id, concat('src', CAST(e.event_id % 18 AS STRING)) AS source_name, e.ts - INTERVAL '5' MINUTE AS started_at, e.ts AS finished_at,
       CAST(floor(e.value) AS INT) AS inserted, CAST(e.user_id % 5 AS INT) AS skipped, CAST(e.user_id % 3 AS INT) AS parse_skipped,
       CASE WHEN e.event_type = 'error' THEN 'fetch failed' END AS error
  FROM {events} e""",
    "picks": """
SELECT CAST(date_trunc('week', e.ts) AS DATE) AS digest_date, e.event_id % (SELECT count(*) FROM {documents}) AS document_id,
       max(CASE WHEN e.user_id % 2 = 0 THEN 'jev' END) AS reporter, min(e.ts) AS created_at
  FROM {events} e
 WHERE e.event_type = 'signup' AND e.event_id % 5 = 0 GROUP BY 1, 2""",
    "frames": """
SELECT conv_id AS document_id, turn AS frame_index,
       CASE WHEN role = 'system' THEN 'NO_TEXT' ELSE text END AS image_text, 'm1' AS model
  FROM {conversations}""",
}
_READS = {"documents": ("documents", "labels"), "sources": ("documents",), "runs": ("events",), "frames": ("conversations",)}


@dataclass
class Tables:
    """Every table of the engine, made when first asked for."""

    spark: SparkSession
    sf_dir: str
    made: dict[str, DataFrame] = field(default_factory=dict)
    #: Snapshots of the logs (operators.states.States), where they are kept.
    states: object | None = None
    #: The index of the documents' trigrams (operators.keywords.KeywordIndex), where there is one.
    keywords: object | None = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self.made:
            used = {t: self.raw(t) for t in _READS.get(name, ("documents", "events"))}
            self.made[name] = self.spark.sql(VIEWS[name].replace("{NTZ}", "TIMESTAMP_NTZ"), **used)
        return self.made[name]


def oracle_prelude(*names: str) -> str:
    """The same tables as the leading CTEs v_<name> of a DuckDB query."""
    out = []
    for n in names:
        sql = VIEWS[n].replace("{NTZ}", "TIMESTAMP").replace("AS STRING", "AS VARCHAR")
        for t in ("documents", "labels", "events", "conversations"):
            sql = sql.replace("{" + t + "}", t)
        out.append(f"v_{n} AS ({sql})")
    return "WITH " + ",\n".join(out)


#: Whether a table was found to be small; it is counted once, not for every plan that joins it.
_SMALL: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def small(df: DataFrame, most: int = 100_000, of: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else as it is for a shuffled join; of: the table that df selects columns of."""
    of = df if of is None else of
    if of not in _SMALL:
        _SMALL[of] = of.limit(most + 1).count() <= most
    return F.broadcast(df) if _SMALL[of] else df
