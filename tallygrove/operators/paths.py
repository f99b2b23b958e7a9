"""Keys for the nodes of a path hierarchy.

A node's key is every component with a slash before it: the root is '', the path `a/b` is
'/a/b' and `/a` is '//a'. So components, also empty ones, and keys map one to one.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_key(path: Column) -> Column:
    return F.concat(F.lit("/"), path)


def depth(key: Column) -> Column:
    """Number of components; 0 for the root."""
    return F.length(key) - F.length(F.replace(key, F.lit("/"), F.lit("")))


def parent_key(key: Column) -> Column:
    """Null for the root."""
    return F.when(key != "", F.regexp_replace(key, "/[^/]*$", ""))


def name_of(key: Column) -> Column:
    """Last component; '' for the root."""
    return F.substring_index(key, "/", -1)


def ancestor_keys(key: Column) -> Column:
    """Keys of all proper ancestors, the root first. Not for the root itself."""
    slash = F.lit("/")
    return F.transform(
        F.sequence(F.lit(1), depth(key)), lambda k: F.call_function("substring_index", key, slash, k)
    )


def components(key: Column) -> Column:
    """The key as an array: sorting by it lists a tree depth first."""
    parts = F.split(key, "/", -1)
    return F.slice(parts, 2, F.size(parts))
