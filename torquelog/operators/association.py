"""Associations between keywords, parts and error codes; rules; trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torquelog.functions import ngrams
from torquelog.operators import entities
from torquelog.operators.ranking import top_k
from torquelog.runtime import lookup_join, materialize, once


def keyword_group_lift(df: DataFrame, key: str, group: str, tokens: str, least: int = 5) -> DataFrame:
    """How much more often a word occurs in a group's records than overall.

    (group, word, records, lift), for words in at least ``least`` records of the group.
    """
    present = df.select(key, group, F.explode(F.array_distinct(tokens)).alias("word"))
    pairs = materialize(present.groupBy(group, "word").agg(F.count(F.lit(1)).alias("records")))
    totals = materialize(
        df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("in_group"))
    )
    overall = pairs.where(F.col(group).isNotNull()).groupBy("word").agg(
        F.sum("records").alias("with_word")
    )
    everything = totals.agg(F.sum("in_group")).first()[0] or 0
    frequent = pairs.where(F.col("records") >= least)
    joined = lookup_join(
        lookup_join(frequent, totals, [group], ready=True), overall, ["word"]
    )
    lift = F.col("records") * F.lit(everything) / (F.col("in_group") * F.col("with_word"))
    return joined.select(group, "word", "records", F.round(lift, 6).alias("lift"))


def code_cooccurrence(df: DataFrame, group: str, code: str, least: int = 1) -> DataFrame:
    """Code pairs seen in the same group: (code_a, code_b, groups, lift), code_a < code_b.

    Groups shrink to their distinct codes first, so a hot group is bounded by the code list, and
    pairs are counted inside the task that forms them. A code in fewer than ``least`` groups cannot
    be in a counted pair and is left out before pairs are formed.
    """
    seen = df.where(F.col(code).isNotNull()).select(group, F.col(code).alias("code"))
    codes = materialize(seen.distinct())
    total = codes.select(group).distinct().count()
    single = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    single = materialize(single)
    kept = lookup_join(codes, single.select("code"), ["code"], "left_semi", ready=True)
    sets = kept.groupBy(group).agg(F.sort_array(F.collect_set("code")).alias("codes"))
    rest = F.transform(
        F.col("codes"),
        lambda c, i: F.struct(
            c.alias("code_a"), F.slice("codes", i + 2, F.size("codes")).alias("later")
        ),
    )
    pairs = (
        once(sets, "codes", F.col("codes"))
        .select(F.inline(rest))
        .select("code_a", F.explode("later").alias("code_b"))
        .groupBy("code_a", "code_b")
        .agg(F.count(F.lit(1)).alias("groups"))
        .where(F.col("groups") >= least)
    )
    a = single.select(F.col("code").alias("code_a"), F.col("n").alias("n_a"))
    b = single.select(F.col("code").alias("code_b"), F.col("n").alias("n_b"))
    joined = lookup_join(lookup_join(pairs, a, ["code_a"], ready=True), b, ["code_b"], ready=True)
    lift = F.col("groups") * F.lit(total) / (F.col("n_a") * F.col("n_b"))
    return joined.select("code_a", "code_b", "groups", F.round(lift, 6).alias("lift"))


def trend(df: DataFrame, ts: str, category: str, unit: str = "month") -> DataFrame:
    """Records per period and category, with the change against the category's previous period.

    Before its first period a category counts as 0.
    """
    period = F.date_format(F.date_trunc(unit, F.col(ts)), "yyyy-MM-dd")
    counts = df.groupBy(period.alias("period"), F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("records")
    )
    order = Window.partitionBy("category").orderBy("period")
    return counts.withColumn(
        "change", F.col("records") - F.lag("records", 1, 0).over(order)
    )


def one_hot(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """One 0/1 column per value; values not listed give a row of zeros."""
    flags = [
        F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values
    ]
    return df.select(key, *flags)


def forward_chain(
    records: DataFrame, key: str, tokens: str, phrase_rules: dict[str, str], fact_rules: dict[str, str]
) -> DataFrame:
    """Facts per record: phrase rules fire on the text, fact rules on facts, until nothing is new.

    Rule tables are small constants, so the chain is closed on them before the data is read: each
    fact maps to everything that follows from it, and the records need one narrow pass.
    """
    follows = {fact: _closure(fact, fact_rules) for fact in {*phrase_rules.values(), *fact_rules}}
    per_phrase = {p: [f, *follows.get(f, [])] for p, f in phrase_rules.items()}
    table = F.create_map(
        *[x for p, facts in per_phrase.items() for x in (F.lit(p), F.array(*[F.lit(f) for f in facts]))]
    )
    matched = ngrams.matched_phrases(F.col(tokens), list(phrase_rules))
    facts = F.array_sort(F.array_distinct(F.flatten(F.transform(matched, lambda p: table[p]))))
    return once(records, "facts", facts).where(F.size("facts") > 0)


def _closure(fact: str, rules: dict[str, str]) -> list[str]:
    seen: list[str] = []
    while fact in rules and rules[fact] not in seen:
        fact = rules[fact]
        seen.append(fact)
    return seen


def rule_priority(feedback: DataFrame, rule: str, worked: Column) -> DataFrame:
    """Success rate per rule and its priority, the best rate first."""
    rates = feedback.groupBy(rule).agg(
        F.count(F.lit(1)).alias("tries"), F.round(F.avg(worked.cast("double")), 6).alias("success")
    )
    small = materialize(rates)  # one row per rule
    return small.withColumn(
        "priority", F.dense_rank().over(Window.orderBy(F.desc("success")))
    )


def enrich(
    keywords: DataFrame, key: str, resources: DataFrame, resource: str, tokens: str, k: int = 3
) -> DataFrame:
    """For each keyword of a record, the ``k`` external texts that use it most.

    The external index is cut to ``k`` texts per word, the answer itself, before it meets the
    records, so a word found everywhere costs no more than a rare one.
    (key, gram, resource, uses, rank)
    """
    uses = resources.select(resource, F.explode(tokens).alias("gram")).groupBy(resource, "gram").agg(
        F.count(F.lit(1)).alias("uses")
    )
    index = top_k(uses, ["gram"], [F.desc("uses"), F.col(resource)], k)
    return lookup_join(keywords.select(key, "gram"), index, ["gram"], salt_all=True).select(
        key, "gram", resource, "uses", "rank"
    )


def gazetteer(
    df: DataFrame, key: str, tokens: str, entries: DataFrame, sizes: tuple[int, ...]
) -> DataFrame:
    """Dictionary entities of some numbers of words in text: (key, entity, kind, mentions).

    All are counted, also those inside others; ``entities.find_terms`` has the longest ones, too.
    """
    wanted = entries.where(F.size(F.split("entity", " ")).isin(*sizes))
    return entities.mentions(entities.find_terms(df.select(key, tokens), tokens, wanted), key, tokens)
