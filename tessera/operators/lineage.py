"""Lineage guards, group-safe splits and manifests.

The statistical unit is the source group; every guard returns the offending
rows and raises only in its ``check_`` form, which is an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


class LeakageError(AssertionError):
    """Lineage that touches hidden test data."""


class HoldoutLeakageError(AssertionError):
    """Lineage that touches held-out validation data."""


class ModalityClaimError(AssertionError):
    """A text that claims a modality the data don't have."""


def contaminated(lineage: DataFrame, forbidden_ids: DataFrame, forbidden_groups: DataFrame, group_of: DataFrame) -> DataFrame:
    """Ids of ``lineage`` that are forbidden, name a forbidden group, or belong to one. All tables have one column id, but group_of (id, group_id)."""
    bad = forbidden_ids.select("id").unionByName(forbidden_groups.select("id")).distinct()
    named = lineage.select("id").distinct()
    groups = named.join(group_of.select("id", "group_id"), "id", "left")
    via = groups.join(forbidden_groups.select(F.col("id").alias("group_id")).distinct(), "group_id", "left_semi").select("id")
    return named.join(bad, "id", "left_semi").unionByName(via).distinct()


def check(lineage: DataFrame, forbidden_ids: DataFrame, forbidden_groups: DataFrame, group_of: DataFrame, error: type[AssertionError] = LeakageError) -> None:
    """Raise ``error`` with the first offending ids, if there are any."""
    found = [str(r[0]) for r in contaminated(lineage, forbidden_ids, forbidden_groups, group_of).orderBy("id").limit(20).collect()]
    if found:
        raise error("forbidden lineage: " + ", ".join(found))


def claims(texts: DataFrame, text: str = "text", token: str = "SEM") -> DataFrame:
    """Rows whose text holds the token as a whole word, in this case of letters; underscores belong to words."""
    return texts.filter(F.col(text).rlike(rf"\b{token}\b"))


def check_claims(texts: DataFrame, text: str = "text", token: str = "SEM") -> None:
    if not claims(texts, text, token).isEmpty():
        raise ModalityClaimError(f"a text claims {token}")


def split_groups(rows: DataFrame) -> DataFrame:
    """Groups that are in more than one split: (group_id, splits). A row without a group is its own."""
    g = rows.select(F.coalesce("group_id", F.col("source_id").cast("string")).alias("group_id"), "split")
    return g.groupBy("group_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def check_split(rows: DataFrame) -> None:
    found = [r[0] for r in split_groups(rows).orderBy("group_id").limit(20).collect()]
    if found:
        raise LeakageError("groups in several splits: " + ", ".join(found))


def pairwise_overlaps(rows: DataFrame) -> DataFrame:
    """(a, b, n): groups that each two splits share."""
    g = rows.select("group_id", "split").distinct()
    return g.withColumnRenamed("split", "a").join(g.withColumnRenamed("split", "b"), "group_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def group_split(rows: DataFrame, test_groups: DataFrame, val_fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """(source_id, group_id, split): given test groups stay; of the others, in the order of a seeded hash, the first share are validation.

    max(1, round half to even of share) groups are held out. The rank is over
    groups alone, one row each.
    """
    test = test_groups.select("group_id").distinct().withColumn("is_test", F.lit(True))
    groups = rows.select("group_id").distinct().join(test, "group_id", "left")
    rest = groups.filter("is_test IS NULL").select("group_id", F.row_number().over(Window.orderBy(expr.uniform(seed, F.col("group_id")), "group_id")).alias("k"))
    n = rest.agg(F.greatest(F.lit(1), F.bround(F.count("*") * val_fraction, 0).cast("int")).alias("n_val"))
    named = rest.join(n).select("group_id", F.when(F.col("k") <= F.col("n_val"), "validation").otherwise("train").alias("split"))
    named = named.unionByName(groups.filter("is_test").select("group_id", F.lit("test").alias("split")))
    return rows.select("source_id", "group_id").join(named, "group_id").select("source_id", "group_id", "split")


def with_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows with their split, ``unassigned`` for ids that have none."""
    return rows.join(split.select("source_id", "split"), "source_id", "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def eligible(split: Column) -> Column:
    return F.coalesce(split != "test", F.lit(True))


def manifest(*parts: DataFrame) -> DataFrame:
    """The union of dataset manifests, checked for groups across splits."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    check_split(out)
    return out


def audit(rows: DataFrame) -> DataFrame:
    """(dataset, images, groups, largest_group)."""
    per = rows.groupBy("dataset", "group_id").agg(F.count("*").alias("n"))
    return per.groupBy("dataset").agg(F.sum("n").alias("images"), F.count("*").alias("n_groups"), F.max("n").alias("largest_group"))


def members(rows: DataFrame) -> DataFrame:
    """(group_id, ids): sorted members of each group."""
    return rows.groupBy("group_id").agg(F.array_sort(F.collect_list("source_id")).alias("ids"))
