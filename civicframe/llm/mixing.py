"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is root, domain, language, source. A budget of tokens goes down the tree: at every node the
children share it by weight, and what a child cannot use (its capacity is MAX_EPOCHS times the tokens
below it) is shared out again among its siblings. As a child's capacity is that of its whole subtree,
a shortage stays among siblings as long as they can take it and reaches the ancestors' siblings only
then. Each leaf takes whole epochs and then the longest prefix of whole documents, in an order seeded
by leaf epoch and identifier, that fits what is left of its budget.

Budgets are exact integers (rounded down). The order is that of md5(seed:epoch:identifier); the prefix
is found from sums over 4096 ranges of that order, so no leaf has to be sorted in one task.
Null languages, sources and domains are `unknown`; null texts have no tokens; a document without
tokens is taken when it stands within the prefix. Rows that share an identifier are ordered next to
each other. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from civicframe.llm.common import WORD, table, written

SEED, MAX_EPOCHS, BUDGET_PERMILLE = 20, 2, 600
#: Weights by name at each level of the production query; other names weigh 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The production query's domains: the source's number modulo 4."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("string")), F.lit("unknown"))


def weight_of(level: str, weights: dict) -> Column:
    out = F
    for name, value in sorted(weights.get(level, {}).items()):
        out = out.when(F.col(level) == name, F.lit(value))
    return (F.lit(1) if out is F else out.otherwise(F.lit(1))).cast("decimal(38,0)")


def _share(nodes: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """Splits column budget of each parent among its children (rows) by weight, up to their capacity cap."""
    nodes = nodes.withColumn("w", weight_of(level, weights))
    group = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = group.orderBy(F.try_divide(F.col("cap").cast("double"), F.col("w").cast("double")).asc_nulls_last(), level).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    return (
        nodes.withColumn("before", F.coalesce(F.sum("cap").over(order), zero).cast("decimal(38,0)"))
        .withColumn("w_before", F.coalesce(F.sum("w").over(order), zero).cast("decimal(38,0)"))
        .withColumn("w_all", F.sum("w").over(group).cast("decimal(38,0)"))
        .withColumn("full", F.expr("w > 0 AND cap * (w_all - w_before) <= (budget - before) * w"))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), zero).cast("decimal(38,0)"))
        .withColumn("w_spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(group), zero).cast("decimal(38,0)"))
        .withColumn("budget", F.expr("CASE WHEN full THEN cap WHEN w = 0 THEN CAST(0 AS DECIMAL(38,0)) ELSE CAST(((budget - spent) * w) div (w_all - w_spent) AS DECIMAL(38,0)) END"))
        .drop("w", "before", "w_before", "w_all", "full", "spent", "w_spent")
    )


def budgets(leaves: DataFrame, weights: dict = WEIGHTS, permille: int = BUDGET_PERMILLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> the same with budget, the leaf's tokens in the mixture."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("decimal(38,0)"))
    caps = F.sum("cap").cast("decimal(38,0)").alias("cap")
    total = leaves.agg(F.expr(f"CAST((coalesce(sum(tokens), 0) * {permille}) div 1000 AS DECIMAL(38,0))").alias("budget"))
    now = total
    for i, level in enumerate(LEVELS):
        parent = list(LEVELS[:i])
        nodes = leaves.groupBy(*LEVELS[: i + 1]).agg(caps)
        nodes = nodes.join(now, parent) if parent else nodes.crossJoin(F.broadcast(now))  # one row
        now = _share(nodes, parent, level, weights).drop("cap")
    return leaves.drop("cap").join(now, list(LEVELS))


def mixture(docs: DataFrame, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", weights: dict = WEIGHTS, permille: int = BUDGET_PERMILLE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: id, domain, lang, source, tokens, copies (how many epochs take it)."""
    unknown = F.lit("unknown")
    counted = written(
        docs.select(
            F.col(id_col).alias("id"), (domain_of(F.col("source")) if domain is None else F.coalesce(domain, unknown)).alias("domain"),
            F.coalesce("lang", unknown).alias("lang"), F.coalesce("source", unknown).alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        ),
        "tokens",
    )
    leaf = (
        budgets(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, permille, max_epochs)
        .select(*LEVELS, F.expr("CASE WHEN tokens > 0 THEN CAST(budget div tokens AS BIGINT) ELSE 0 END").alias("whole"), F.col("tokens").alias("leaf_tokens"), "budget")
        .withColumn("rest", F.expr("CAST(budget - whole * leaf_tokens AS BIGINT)"))
        .drop("leaf_tokens", "budget")
    )
    keyed = counted.join(leaf, list(LEVELS)).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))).withColumn("range", F.substring("key", 1, 3))
    by_range = [*LEVELS, "range"]
    ranges = (
        keyed.groupBy(*by_range).agg(F.sum("tokens").alias("n"))
        .withColumn("prior", F.sum("n").over(W.partitionBy(*LEVELS).orderBy("range")) - F.col("n")).drop("n")
    )
    within = W.partitionBy(*by_range).orderBy("key", "id", "tokens").rowsBetween(W.unboundedPreceding, 0)
    return (
        keyed.withColumn("upto", F.sum("tokens").over(within)).join(ranges, by_range)
        .select(F.col("id").alias(id_col), *LEVELS, "tokens", (F.col("whole") + F.expr("CAST(prior + upto <= rest AS INT)")).cast("long").alias("copies"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, each as often as epochs take it, with the columns of docs."""
    id_col = options.get("id_col", "doc_id")
    taken = mixture(docs, **options).groupBy(F.col(id_col).alias("taken_id")).agg(F.max("copies").alias("taken_copies")).filter("taken_copies > 0")
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)])
    key = f"own_{docs.columns.index(id_col)}"
    return (
        own.join(taken, F.col(key).eqNullSafe(F.col("taken_id")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("taken_copies").cast("int"))))
        .select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _level_sql(name: str, source: str, keys: tuple[str, ...], weight: str) -> str:
    parent, level = ", ".join(keys[:-1]) or "0", keys[-1]
    over = f"(PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
        {name}_n AS ({source}),
        {name}_w AS (SELECT *, CAST({weight} AS HUGEINT) AS w FROM {name}_n),
        {name}_f AS (SELECT *, coalesce(sum(cap) OVER {over}, 0) AS before, coalesce(sum(w) OVER {over}, 0) AS w_before,
        sum(w) OVER (PARTITION BY {parent}) AS w_all FROM {name}_w),
        {name}_s AS (SELECT *, cap * (w_all - w_before) <= (budget - before) * w AS filled FROM {name}_f),
        {name} AS (SELECT {", ".join(keys)},
        CASE WHEN filled THEN cap ELSE ((budget - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY {parent}), 0)) * w)
            // (w_all - coalesce(sum(w) FILTER (filled) OVER (PARTITION BY {parent}), 0)) END AS budget FROM {name}_s)"""


ORACLE = {
    "op5_mixing": rf"""
        WITH d AS (SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INT) % 4), 'unknown') AS domain,
            coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
            coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
        leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {MAX_EPOCHS} AS HUGEINT) AS cap
        FROM d GROUP BY ALL),
        {_level_sql("l1", f"SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, (SELECT CAST(sum(tokens) AS HUGEINT) * {BUDGET_PERMILLE} // 1000 FROM leaf) AS budget FROM leaf GROUP BY domain", ("domain",), "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END")},
        {_level_sql("l2", "SELECT domain, lang, CAST(sum(cap) AS HUGEINT) AS cap, any_value(budget) AS budget FROM leaf JOIN l1 USING (domain) GROUP BY domain, lang", ("domain", "lang"), "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
        {_level_sql("l3", "SELECT domain, lang, source, cap, budget FROM leaf JOIN l2 USING (domain, lang)", ("domain", "lang", "source"), "1")},
        b AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE
        WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest FROM leaf JOIN l3 USING (domain, lang, source)),
        k AS (SELECT *, md5('{SEED}:' || whole || ':' || doc_id) AS key FROM d JOIN b USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, tokens, CAST(whole + CAST(sum(tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) <= rest AS INT) AS BIGINT) AS copies FROM k"""
}
