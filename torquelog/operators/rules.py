"""Forward chaining over a table of rules, by joins of the facts that are new in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelog.runtime import materialize


def rule_table(spark, rules: list[tuple[str, list[str], str]]) -> DataFrame:
    """(rule, premise, conclusion), one row per premise, from (rule, premises, conclusion)."""
    rows = [(name, p, conclusion) for name, premises, conclusion in rules for p in premises]
    return spark.createDataFrame(rows, "rule string, premise string, conclusion string")


def word_facts(records: DataFrame, key: str, tokens: str, rules: DataFrame) -> DataFrame:
    """(key, fact): the words of a record that are a premise of some rule."""
    words = records.select(F.col(key).alias("key"), F.explode(F.array_distinct(tokens)).alias("fact"))
    return words.join(rules.select(F.col("premise").alias("fact")).distinct(), "fact", "left_semi")


def derive(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """All facts that follow: (key, fact, round), round 0 being the ``facts`` (key, fact) given.

    ``rules`` has a row (rule, premise, conclusion) per premise; a rule fires for a key once all its
    premises are known. Evaluation is semi-naive: a round joins only the facts that were new in the
    round before, and adds the premises they meet to those met earlier, of the rules they touch. A
    fact is new once, so rounds end also where rules form a cycle. Null keys, facts and premises take
    no part; repeated rows count once; a rule with several conclusions has rows for each of them.
    """
    rules = rules.where("premise IS NOT NULL AND conclusion IS NOT NULL").distinct()
    rules = materialize(rules)
    needed = rules.groupBy("rule", "conclusion").agg(F.count(F.lit(1)).alias("needed"))
    new = facts.where("key IS NOT NULL AND fact IS NOT NULL").select("key", "fact").distinct()
    new = materialize(new.withColumn("round", F.lit(0)))
    known, met, turn = new, None, 0
    while not new.isEmpty():
        turn += 1
        hits = new.select("key", F.col("fact").alias("premise")).join(rules, "premise")
        hits = hits.groupBy("key", "rule", "conclusion").agg(F.count(F.lit(1)).alias("met"))
        hits = materialize(hits)
        total = hits
        if met is not None:
            touched = hits.select("key", "rule", "conclusion")
            earlier = met.join(touched, ["key", "rule", "conclusion"], "left_semi")
            total = hits.unionByName(earlier).groupBy("key", "rule", "conclusion").agg(F.sum("met").alias("met"))
        fired = total.join(needed, ["rule", "conclusion"]).where("met = needed")
        found = fired.select("key", F.col("conclusion").alias("fact")).distinct()
        new = found.join(known, ["key", "fact"], "left_anti").withColumn("round", F.lit(turn))
        new = materialize(new)
        known = known.unionByName(new)
        met = hits if met is None else met.unionByName(hits)
    return known
