"""The controlled topic vocabulary as a dimension table, and lookups by any known spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slug | kind | label | synonyms, comma-separated | slug that replaces a retired one.
TOPICS = """
gen-z | pillar | Gen Z | gen z, genz, generation z, zoomers |
gen-z-self-purchase | pillar | Gen Z self-purchase | self purchase, self-purchase, gen z self purchase, genz self purchase |
consumer-behavior | pillar | Consumer behavior | consumer behaviour, shopper behavior, buying behavior, consumption patterns |
consumer-trends | pillar | Consumer trends | consumer trends, trends | consumer-behavior
luxury | pillar | Luxury | luxury goods, luxury sector, high-end, premium |
jewelry | pillar | Jewelry | jewellery, fine jewelry, jewelry industry |
fashion | pillar | Fashion | apparel, fashion industry, style |
beauty | pillar | Beauty | beauty industry, cosmetics, skincare |
retail | pillar | Retail | retail industry, retailing, brick-and-mortar |
e-commerce | pillar | E-commerce | ecommerce, online retail, digital commerce, dtc, direct-to-consumer |
social-media | pillar | Social media | social platforms, social networks, social |
social-commerce | pillar | Social commerce | social shopping, shoppable content, live commerce, livestream commerce |
creator-economy | pillar | Creator economy | creators, influencers, influencer economy |
influencer-marketing | pillar | Influencer marketing | influencer marketing, influencer campaigns | creator-economy
marketing | pillar | Marketing | advertising, brand marketing, marketing industry |
brand-strategy | pillar | Brand strategy | branding, brand positioning, brand purpose |
technology | pillar | Technology | tech, innovation |
ai | pillar | AI | artificial intelligence, machine learning, genai, generative ai |
culture | pillar | Culture | cultural trends, pop culture |
sustainability | pillar | Sustainability | esg, responsible sourcing, ethical sourcing, circular economy |
global | region | Global | worldwide, international |
latam | region | Latin America | latin america, south america, central america |
usa | region | United States | us, u.s., united states, america |
uk | region | United Kingdom | united kingdom, great britain, britain, england |
europe | region | Europe | eu, european union |
asia | region | Asia | asia-pacific, apac |
china | region | China | mainland china, chinese market |
brazil | region | Brazil | brasil |
mexico | region | Mexico | méxico |
spain | region | Spain | españa |
colombia | region | Colombia | colombia, republic of colombia |
argentina | region | Argentina | argentina, argentine republic |
news | content-type | News | news article, breaking news |
analysis | content-type | Analysis | deep dive, deep-dive, insight, insights |
opinion | content-type | Opinion | op-ed, editorial, column, commentary |
interview | content-type | Interview | q&a, qa |
report | content-type | Report | research report, whitepaper, study, research |
press-release | content-type | Press release | press release, pr, announcement, newswire |
product-launch | content-type | Product launch | launch, new product, collection launch, drop |
campaign | content-type | Campaign | ad campaign, marketing campaign, advertising campaign |
earnings | content-type | Earnings | financial results, results, trading update, quarterly results |
event | content-type | Event | trade show, conference, expo, trade fair |
"""
#: The topics of a period bundle without a topic filter.
PRIORITY_TOPICS = ("gen-z", "consumer-behavior", "jewelry", "social-media", "creator-economy", "marketing", "brand-strategy", "ai", "latam", "mexico", "brazil", "colombia", "argentina", "report", "campaign", "earnings")


def vocabulary(spark: SparkSession) -> DataFrame:
    """(ordinal, slug, kind, label, synonyms, retired_alias_of) in registry order; 42 rows."""
    rows = []
    for k, line in enumerate(TOPICS.strip().splitlines()):
        slug, kind, label, synonyms, target = (x.strip() for x in line.split("|"))
        rows.append((k, slug, kind, label, [s.strip() for s in synonyms.split(",")], target or None))
    return spark.createDataFrame(rows, "ordinal int, slug string, kind string, label string, synonyms array<string>, retired_alias_of string")


def topic_key(tag: Column) -> Column:
    """Case-, blank- and separator-insensitive key of a spelling."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(tag), r"(?U)[\s_-]+", " ")), " ", "-")


def spellings(spark: SparkSession) -> DataFrame:
    """(key, slug): every slug, label and synonym; the first in registry order wins."""
    v = vocabulary(spark)
    alias = F.concat(F.array("slug", "label"), "synonyms")
    rows = v.select("ordinal", F.coalesce("retired_alias_of", "slug").alias("slug"), F.posexplode(alias).alias("turn", "spelling")).withColumn("key", topic_key(F.col("spelling")))
    return rows.groupBy("key").agg(F.min_by("slug", F.struct("ordinal", "turn")).alias("slug"))


def canonicalize_topics(df: DataFrame, tag_col: str) -> DataFrame:
    """df with `slug`, null for an unknown spelling. The vocabulary has some 150 spellings, so it is broadcast."""
    index = F.broadcast(spellings(df.sparkSession).withColumnRenamed("key", "_key"))
    return df.join(index, topic_key(F.col(tag_col)) == F.col("_key"), "left").drop("_key")


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    turn = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_turn", F.row_number().over(turn)).filter("_turn = 1").drop("_turn")
