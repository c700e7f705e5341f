"""Model judgments to tags and scores, under confidence gates.

Judgments: (document_id, axis, probabilities map<string,double>, choice, confidence, score).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vocabulary import vocabulary

#: Fixed values.
TAG_GATE = 0.2
WRITE_GATE = 0.5
TOKEN_PRICE = 0.042
REPORTER = "jev"
JUDGMENTS = "document_id long, axis string, probabilities map<string,double>, choice string, confidence double, score double"


def choice_tags(judgments: DataFrame, axis: str, tag_gate: float = TAG_GATE, write_gate: float = WRITE_GATE) -> DataFrame:
    """(document_id, tags): live slugs of the axis that are likely enough, in registry order; only of confident answers."""
    live = F.broadcast(vocabulary(judgments.sparkSession).filter((F.col("kind") == axis) & F.col("retired_alias_of").isNull()).select("slug", "ordinal"))
    p = judgments.filter((F.col("axis") == axis) & (F.col("confidence") >= write_gate)).select("document_id", F.explode("probabilities").alias("slug", "p"))
    p = p.filter(F.col("p") >= tag_gate).join(live, "slug")  # live is broadcast: some forty rows
    tags = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "slug"))), lambda x: x["slug"])
    return p.groupBy("document_id").agg(tags.alias("tags"))


def content_type_tag(judgments: DataFrame) -> DataFrame:
    """(document_id, tag, cause): the first choice whatever its confidence; a cause where it isn't known."""
    live = F.broadcast(vocabulary(judgments.sparkSession).filter((F.col("kind") == "content-type") & F.col("retired_alias_of").isNull()).select(F.col("slug").alias("tag")))
    j = judgments.filter(F.col("axis") == "content-type").join(live, F.col("choice") == F.col("tag"), "left")
    return j.select("document_id", "tag", F.when(F.col("tag").isNull(), F.concat(F.lit("unknown content type: "), F.coalesce("choice", F.lit("")))).alias("cause"))


def digest_importance(judgments: DataFrame) -> DataFrame:
    """(document_id, score, rationale) of confident digest answers: 0 to 3 as 0 to 1."""
    j = judgments.filter((F.col("axis") == "digest") & (F.col("confidence") >= WRITE_GATE))
    s = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(3.0)) / 3
    return j.select("document_id", s.alias("score"), F.format_string("digest relevance %.2f of 3 (confidence %.2f)", "score", "confidence").alias("rationale"))


def read_off(judgments: DataFrame) -> DataFrame:
    """(document_id, topics, score, rationale, cause) of each judged document."""
    ids = judgments.select("document_id").distinct()
    pillar, region = (choice_tags(judgments, a).withColumnRenamed("tags", f"_{a}") for a in ("pillar", "region"))
    d = ids
    for part in (pillar, region, content_type_tag(judgments), digest_importance(judgments)):
        d = d.join(part.hint("merge"), "document_id", "left")
    none = F.array().cast("array<string>")
    topics = F.concat(F.coalesce("_pillar", none), F.coalesce("_region", none), F.when(F.col("tag").isNotNull(), F.array("tag")).otherwise(none))
    suppressed = (F.size(topics) == 0) & F.col("score").isNull() & F.col("cause").isNull()
    return d.select("document_id", topics.alias("topics"), "score", "rationale", F.when(suppressed, "low-confidence").otherwise(F.col("cause")).alias("cause"))


def judged(docs: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Judgments by a scorer of one's own: it gets frames of (id, title, source, content) and yields rows of JUDGMENTS."""
    return model_input(docs).mapInPandas(scorer, JUDGMENTS)


def annotation_totals(rows: DataFrame) -> DataFrame:
    """Of (document_id, cause, tokens): annotated, skipped, tokens, cost."""
    return rows.agg(F.sum(F.col("cause").isNull().cast("long")).alias("annotated"), F.sum(F.col("cause").isNotNull().cast("long")).alias("skipped"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / 1e6 * TOKEN_PRICE).alias("cost"))


def model_input(docs: DataFrame) -> DataFrame:
    return docs.select("id", "title", "source", F.substring("content", 1, 3000).alias("content"))
