"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source has target weights on its edges.  The
token budget flows from the root to the leaves in proportion to the weights.  A
node can't take more than `max_epochs` times the tokens below it; what it can't
take goes to its siblings, in proportion to their weights, and only what no
sibling can take goes up to the siblings of the parent (a parent's own capacity
is that of its children together).  Each leaf then takes a prefix of its
seeded epochs: epoch after epoch, the leaf's documents in the order of
md5(seed:epoch:doc_id), until the leaf's budget is met; the document that meets
it is the last.

Per document only id, leaf and token count are kept for this.  The order is cut
into buckets by its first hex digits: bucket totals give running sums with a
row per leaf and bucket, whole buckets are taken or left at once, and only the
one bucket that the budget ends in is summed row by row.  No task sees a leaf
whole, so a leaf may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.llm._spark import n_words, text_of, written

LEVELS = ("domain", "lang", "source")


def budgets(leaves: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], float], budget: float, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens that each leaf gives.

    leaves: tokens by path.  weights: by the path of any node, relative to its
    siblings; a node without one has weight 1, and weight 0 gets nothing.
    Leaves without tokens get nothing.
    """
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    capacity: dict[tuple[str, ...], float] = {}
    for path, tokens in leaves.items():
        usable = all(weights.get(path[:k], 1.0) > 0 for k in range(1, len(path) + 1))
        for k in range(len(path) + 1):
            capacity[path[:k]] = capacity.get(path[:k], 0) + (max_epochs * tokens if usable else 0)
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])
    out: dict[tuple[str, ...], int] = {}

    def share(node: tuple[str, ...], amount: float) -> None:
        amount = min(amount, capacity.get(node, 0))
        if node in leaves:
            out[node] = int(amount + 1e-6)
            return
        open_, given = sorted(children.get(node, ())), {}
        while open_:
            total = sum(weights.get(x, 1.0) for x in open_)
            part = {x: amount * weights.get(x, 1.0) / total if total else 0.0 for x in open_}
            full = [x for x in open_ if part[x] >= capacity[x]]
            if not full:
                given |= part
                break
            for x in full:  # what it can't take stays in `amount`, for its siblings
                given[x] = capacity[x]
                amount -= capacity[x]
            open_ = [x for x in open_ if x not in full]
        for x, y in given.items():
            share(x, y)

    if leaves:
        share((), budget)
    return out


def _weights(weights: dict[tuple[str, ...], float], spark, level: int) -> DataFrame:
    """The weights given for the nodes of a level."""
    rows = [(*path, float(w)) for path, w in weights.items() if len(path) == level]
    return spark.createDataFrame(rows, ", ".join(f"{x} string" for x in LEVELS[:level]) + ", w double")


def leaf_budgets(leaves: DataFrame, weights: dict[tuple[str, ...], float], budget: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, t, amount: as `budgets` gives them, for any number of leaves (domain, lang, source, t).

    Level by level: the children of a node in the order of capacity over weight.  Those that
    come before the level at which the node's amount runs out take their capacity, the others the
    level times their weight; both are running sums over the children.
    """
    spark = leaves.sparkSession
    leaf = leaves.withColumn("cap", (max_epochs * F.col("t")).cast("double"))
    for n in (1, 2, 3):  # a node without weight gives nothing, nor does what is below it
        leaf = leaf.join(F.broadcast(_weights(weights, spark, n).withColumnRenamed("w", f"w{n}")), list(LEVELS[:n]), "left").withColumn(f"w{n}", F.coalesce(f"w{n}", F.lit(1.0)))  # as many as are given
    leaf = leaf.withColumn("cap", F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("cap")).otherwise(0.0))
    whole = leaf.agg(F.least(F.coalesce(F.sum("cap"), F.lit(0.0)), F.lit(float(budget))).alias("a"))
    above, up = whole, []
    for n in (1, 2, 3):
        own = list(LEVELS[:n])
        nodes = leaf.groupBy(*own).agg(F.sum("cap").alias("c"), F.first(f"w{n}").alias("w"), *([F.sum("t").alias("t")] if n == 3 else []))
        nodes = nodes.join(above, up) if up else nodes.join(F.broadcast(above))  # one row
        ratio = F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(F.lit(-1.0))
        order = Window.partitionBy(*up).orderBy("r", *own)
        nodes = nodes.withColumn("r", ratio)
        taken = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        level = F.try_divide(F.col("a") - taken, F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        nodes = nodes.withColumns({"level": level, "i": F.row_number().over(order)})
        open_ = (F.col("level") <= F.col("r")) & (F.col("w") > 0)
        cut = Window.partitionBy(*up)
        first = F.min(F.when(open_, F.struct("i", "r", "level"))).over(cut)
        nodes = nodes.withColumn("first", first)
        share = F.when(F.col("first").isNull() | (F.col("i") < F.col("first.i")), F.col("c")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("c"), F.col("first.level") * F.col("w"))))
        above, up = nodes.select(*own, share.alias("a"), *(["t"] if n == 3 else [])), own
    return above.select(*LEVELS, "t", F.floor(F.col("a") + 1e-6).cast("long").alias("amount"))


def leaf_tokens(documents: DataFrame, domain: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, domain, lang, source and n_tokens of every row; a null level is the string "unknown"."""
    level = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return documents.select(
        F.col(doc_id).alias("doc_id"), level(domain).alias("domain"), level(F.col(lang)).alias("lang"), level(F.col(source)).alias("source"),
        n_words(text_of(text)).alias("n_tokens"), F.xxhash64(text).alias("tie"),
    )


def _key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(
    documents: DataFrame, domain: Column, weights: dict[tuple[str, ...], float], *, budget: float | None = None, budget_share: float = 1.0, max_epochs: int = 4, seed: int = 17, digits: int = 3, **columns
) -> DataFrame:
    """doc_id, domain, lang, source, epoch and n_tokens of every selected reading of a document.

    budget: tokens in all; else `budget_share` of the tokens there are.  digits:
    hex digits of the order key that make a bucket (16**digits buckets a leaf).
    Null and empty texts have no tokens; they come with the
    epochs that reach them.  Rows that repeat are rows of their own.  An empty
    table gives no rows.
    """
    docs = written(leaf_tokens(documents, domain, **columns), "leaf-tokens")
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t"))
    total = leaves.agg(F.sum("t")).first()[0] or 0
    target = leaf_budgets(leaves, weights, total * budget_share if budget is None else budget, max_epochs)
    per = F.when(F.col("t") > 0, F.floor(F.col("amount") / F.col("t"))).otherwise(0).cast("long")
    plan = written(target.select(*LEVELS, per.alias("full_epochs"), F.when(F.col("t") > 0, F.col("amount") - per * F.col("t")).otherwise(0).cast("long").alias("rest")), "leaf-plan")
    placed = docs.join(plan, [*LEVELS])
    whole = placed.filter("full_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_epochs") - 1)))
    last = placed.filter("rest > 0").withColumn("epoch", F.col("full_epochs")).withColumn("k", _key(F.col("epoch"), seed)).withColumn("bucket", F.substring("k", 1, digits))
    before = F.sum("b").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = last.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("b")).withColumn("before", F.coalesce(before, F.lit(0)))
    last = last.join(ends, [*LEVELS, "bucket"]).filter("before < rest")
    inside = F.col("before") + F.col("b") >= F.col("rest")
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("k", "doc_id", "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, -1))
    edge = last.filter(inside).withColumn("run", F.coalesce(running, F.lit(0)) + F.col("before")).filter("run < rest")
    out = [*("doc_id", *LEVELS), "epoch", "n_tokens"]
    return whole.select(*out).unionByName(last.filter(~inside).select(*out)).unionByName(edge.select(*out))
