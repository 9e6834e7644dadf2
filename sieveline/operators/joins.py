"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """``parents LEFT JOIN children`` where a parent may own very many children.

    Adaptive execution can split a skewed side only if that side is preserved or the join
    is inner.  So parents with children are joined inner, and the others, found against the
    distinct keys, are added with empty columns.
    """
    inner = children.join(parents, key)
    childless = parents.join(children.select(key).distinct(), key, "left_anti")
    return inner.unionByName(childless, allowMissingColumns=True)
