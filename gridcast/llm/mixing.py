"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source).  From the root down each node shares its budget among its
children by weight; a child never gets more than what lies below it can give over all epochs, and what
it cannot take goes to its siblings.  A node's own capacity is known first, so a shortage reaches an
ancestor only when all siblings are full.  A leaf's budget is met by whole epochs and the beginning of
one more, in an order seeded by epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.store import settle, small_side

LEVELS = ("domain", "language", "origin")
# Shares of the whole; a language that is not named weighs OTHER, sources of one node weigh alike.
DOMAINS = {"0": 0.4, "1": 0.3, "2": 0.2, "3": 0.1}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2}
OTHER = 0.1


def n_words(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def domain_of(source_col: str = "source") -> Column:
    """One of four domains, by digest of the source."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(source_col).cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int"), F.lit(4)).cast("string")


def _weight(level: str, domains: dict[str, float], languages: dict[str, float]) -> Column:
    named = {"domain": domains, "language": languages}.get(level)
    if named is None:
        return F.lit(1.0)
    out = F.lit(OTHER)
    for name, weight in named.items():
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def share_out(nodes: DataFrame, above: list[str], level: str, weight: Column) -> DataFrame:
    """Adds ``budget`` of each child: the smaller of its capacity and its weight times the level at which the parent's budget is used up.

    Children fill up in order of capacity over weight; the level is the largest of what is left over the
    weights left, taken at each child.
    """
    order = Window.partitionBy(*above).orderBy("_full", level) if above else Window.orderBy("_full", level)
    all_ = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    nodes = nodes.withColumn("_weight", weight).withColumn("_full", F.when(F.col("_weight") > 0, F.col("capacity") / F.col("_weight")).otherwise(float("inf")))
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("_at", F.when(left > 0, (F.col("parent_budget") - before) / left))
    nodes = nodes.withColumn("_level", F.coalesce(F.max("_at").over(all_), F.lit(0.0)))
    budget = F.greatest(F.lit(0.0), F.least(F.col("capacity").cast("double"), F.col("_weight") * F.col("_level")))
    return nodes.withColumn("budget", budget).drop("_weight", "_full", "_at", "_level", "parent_budget")


def budgets(leaves: DataFrame, share: float, epochs: int, domains: dict[str, float], languages: dict[str, float]) -> DataFrame:
    """(domain, language, origin, tokens, quota) of each leaf of (domain, language, origin, tokens)."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    up: list[DataFrame] = []
    for depth in range(1, len(LEVELS) + 1):
        up.append(leaves.groupBy(*LEVELS[:depth]).agg(F.sum("capacity").alias("capacity")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()[0]
    nodes = up[0].withColumn("parent_budget", F.least(F.lit(float(total) * share), F.lit(float(total) * epochs)))
    for depth, level in enumerate(LEVELS):
        given = share_out(nodes, list(LEVELS[:depth]), level, _weight(level, domains, languages))
        if depth + 1 < len(LEVELS):
            given = given.select(*LEVELS[: depth + 1], F.col("budget").alias("parent_budget"))
            nodes = up[depth + 1].join(given, list(LEVELS[: depth + 1]))
    quota = F.floor(F.col("budget") + 1e-6).cast("long")
    return given.select(*LEVELS, quota.alias("quota")).join(leaves.select(*LEVELS, "tokens"), list(LEVELS))


def mix(
    docs: DataFrame,
    share: float = 0.6,
    epochs: int = 2,
    seed: int = 17,
    domains: dict[str, float] | None = None,
    languages: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that are chosen, with _domain, _tokens, _copies: how many epochs a row is in.

    ``share`` is the budget as a share of all words.  A leaf's last epoch takes rows in order of a seeded
    digest as long as the words before them are fewer than what is left of the quota, so it goes over by
    less than one row.  Rows of equal ids have equal digests and are chosen together.  Null languages and
    sources make a leaf of their own, null texts have no words: such rows are in as many epochs as are
    whole.  An empty table gives an empty one.  Columns of the names given here are replaced, others are kept.
    """
    names = docs.drop("_domain", "_tokens", "_copies").columns
    none = F.lit("")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in names],
        domain_of(source_col).alias("_domain"),
        F.coalesce(F.col(lang_col).cast("string"), none).alias("_language"),
        F.coalesce(F.col(source_col).cast("string"), none).alias("_origin"),
        n_words(text_col).alias("_tokens"),
    )
    key = F.coalesce(F.col(id_col).cast("string"), none).alias("key")
    light = settle(rows.select(F.col("_domain").alias("domain"), F.col("_language").alias("language"), F.col("_origin").alias("origin"), key, F.col("_tokens").alias("tokens")))
    leaves = settle(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    plan = budgets(leaves.drop("n"), share, epochs, domains or DOMAINS, languages or LANGUAGES)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    plan = settle(plan.select(*LEVELS, whole.alias("whole"), (F.col("quota") - whole * F.col("tokens")).alias("rest")))

    # The largest leaf has about a thousand rows in each bucket of the order; sums are taken by bucket first.
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    digits = next(d for d in range(1, 14) if most <= 1000 * 16**d)
    ordered = light.join(small_side(plan), list(LEVELS)).where("rest > 0")
    ordered = ordered.withColumn("digest", digest(seed, F.col("whole"), F.col("key"))).withColumn("bucket", F.substring("digest", 1, digits))
    sums = ordered.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("words"))
    leaf = Window.partitionBy(*LEVELS)
    run_ = F.sum("words").over(leaf.orderBy("bucket"))
    cuts = sums.withColumn("upto", run_).withColumn("before", F.col("upto") - F.col("words"))
    cuts = settle(cuts.where("before < rest and upto >= rest").select(*LEVELS, "bucket", "before"))
    inside = ordered.join(small_side(cuts), [*LEVELS, "bucket"])
    position = F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket", "digest"))
    inside = inside.withColumn("start", F.col("before") + position - ties).where("start < rest")
    last = inside.groupBy(*LEVELS).agg(F.max("digest").alias("last"))
    final = plan.join(last, list(LEVELS), "left")
    final = settle(final.select(F.col("domain").alias("_domain"), F.col("language").alias("_language"), F.col("origin").alias("_origin"), F.col("whole").alias("_whole"), "rest", "last"))
    chosen = rows.join(small_side(final), ["_domain", "_language", "_origin"])
    part = (F.col("rest") > 0) & (digest(seed, F.col("_whole"), F.coalesce(F.col(id_col).cast("string"), none)) <= F.col("last"))
    copies = F.col("_whole") + F.when(part, 1).otherwise(0)
    return chosen.withColumn("_copies", copies).where("_copies > 0").select(*names, "_domain", "_tokens", "_copies")


def digest(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each chosen row as often as it has epochs, without the columns that ``mix`` adds.

    Rows without copies, by a null or a number below 1, go.  Columns may hold nulls and texts of any length; equal rows
    are repeated each; an empty table gives an empty one; other columns are kept.
    """
    names = [c for c in mixed.columns if c not in ("_domain", "_tokens", "_copies")]
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))
    return mixed.where("_copies >= 1").select(*[F.col(f"`{c}`") for c in names], copies.alias("_copy")).drop("_copy")
