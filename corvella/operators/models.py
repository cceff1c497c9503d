"""External models: narrow interfaces, and stand-ins that claim no equivalence with a model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class PairScorer(Protocol):
    """Scores (premise, hypothesis) columns; a model behind a service would be called in an Arrow UDF."""

    def score(self, premise: Column, hypothesis: Column) -> Column: ...


class TokenOverlap:
    """A stand-in for entailment: the share of the hypothesis's words that the premise has; 0 for a blank premise."""

    def score(self, premise: Column, hypothesis: Column) -> Column:
        p, h = F.split(F.lower(premise), r"\s+"), F.array_distinct(F.split(F.lower(hypothesis), r"\s+"))
        return F.when(F.trim(premise) == "", 0.0).otherwise(F.size(F.array_intersect(h, p)) / F.size(h))


class EntityLinker(Protocol):
    """Links mentions (mention) to (mention, cui, score, types)."""

    def link(self, mentions: DataFrame) -> DataFrame: ...


#: Semantic types of organisms, places, organisations and groups, which are never a finding's entity (fixed values).
JUNK_TYPES = ["T001", "T002", "T004", "T005", "T007", "T008", "T009", "T010", "T011", "T012", "T013", "T014", "T015", "T083", "T093", "T097"]
#: Human, which counts as junk where mentions are linked but not where hits are looked up (fixed value).
HUMAN = "T016"


def is_junk(with_human: bool = False) -> Column:
    """Links all of whose types are junk (those without any aren't), and short acronyms with any."""
    junk = F.array(*map(F.lit, JUNK_TYPES + [HUMAN] * with_human))
    return ((F.size("types") > 0) & (F.size(F.array_except("types", junk)) == 0)) | (F.trim("mention").rlike("^[A-Z]{2,5}$") & F.arrays_overlap("types", junk))


def best_concept(links: DataFrame) -> DataFrame:
    """The best concept of each mention that isn't junk."""
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "cui")
    return links.where(~is_junk()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def windowed_entailment(pairs: DataFrame, scorer: PairScorer, size: int = 5) -> DataFrame:
    """The best score of a claim over windows of `size` sentences of its premise (id, sentences, claim)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("sentences") - 1, F.lit(0)), F.lit(size))
    w = pairs.select("id", "claim", F.explode(starts).alias("s"), "sentences").withColumn("premise", F.array_join(F.slice("sentences", F.col("s") + 1, F.lit(size)), " "))
    return w.groupBy("id").agg(F.max(scorer.score(F.col("premise"), F.col("claim"))).alias("entailment"))
