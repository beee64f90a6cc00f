"""Joins by n-gram Jaccard similarity with PartEnum signatures (operator 11)."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import discard, stored
from strataform.llm.simhash import _mixed, _shared_keys, connected
from strataform.llm.verify import Near, described, exact_groups, set_nodes


@lru_cache(maxsize=4096)
def _band(number: int, part: int, whole: int) -> tuple[int, int]:
    """Least and greatest size of a band. Sizes of one band differ by a quarter, or as far as sets may that are similar."""
    low = 1 if number == 0 else _band(number - 1, part, whole)[1] + 1
    return low, max(low, low * 5 // 4, low * whole // part)


def bands(size: int, part: int, whole: int) -> list[int]:
    """The bands a set is filed in: its own, and the next one if that holds sets it may be similar to."""
    number = 0
    while _band(number, part, whole)[1] < size:
        number += 1
    following = _band(number + 1, part, whole)[0]
    return [number, number + 1] if whole * size >= part * following else [number]


def distance(number: int, part: int, whole: int) -> int:
    """In how many elements two similar sets of a band differ at most."""
    return 2 * _band(number, part, whole)[1] * (whole - part) // (whole + part)


def signatures(own, part: int, whole: int, groups: int = 3, changed: int = 1):
    """PartEnum signatures of a set (sorted 64-bit hashes), as unsigned words.

    Within a band, similar sets differ in at most ``k = distance(..)`` elements. The domain of elements is hashed
    into ``k // (changed + 1) + 1`` parts, of which one then holds ``changed`` differences or fewer; each part into
    ``groups`` cells, of which all but ``changed`` then hold none. So similar sets agree on the elements
    of some ``groups - changed`` cells of some part; each such choice is a signature. A cell without elements counts
    like any other. Where ``k`` is 0 only equal sets are similar, and there are none.
    """
    import numpy as np

    out = [np.empty(0, np.uint64)]
    if not len(own):
        return out[0]
    place, worth = _mixed(own, 7), _mixed(own, 8)
    subsets = [list(c) for c in combinations(range(groups), groups - changed)]
    for number in bands(len(own), part, whole):
        most = distance(number, part, whole)
        if most == 0:
            continue
        parts = most // (changed + 1) + 1
        cells = (place % np.uint64(parts * groups)).astype(np.int64)
        order = np.argsort(cells, kind="stable")
        sums = np.concatenate([[np.uint64(0)], np.cumsum(worth[order], dtype=np.uint64)])
        ends = np.searchsorted(cells[order], np.arange(parts * groups + 1))
        held = (sums[ends[1:]] - sums[ends[:-1]]).reshape(parts, groups)
        for n, subset in enumerate(subsets):
            name = np.arange(parts, dtype=np.uint64) * np.uint64(len(subsets)) + np.uint64(n) + np.uint64(number << 40)
            out.append(_mixed(held[:, subset].sum(axis=1, dtype=np.uint64) ^ _mixed(name, 9), 10))
    return np.concatenate(out)


def similarity_join(
    df: DataFrame, key: str, text: str, shingle: int = 3, part: int = 9, whole: int = 10, chunk: int = 1024,
) -> DataFrame:
    """``key, n_shingles, component_id`` per row: the size of its text's set of distinct shingles, and the least key
    reachable over pairs whose sets have a Jaccard similarity of ``part / whole`` or more.

    Words are what ASCII white space separates, A-Z lower-cased; fewer words than a shingle make one
    shingle. Equal sets are one node; its PartEnum signatures are filed once, in bands of size. Nodes that share
    one are compared exactly: with the bucket's pivot, then whatever is still apart (``verify.exact_groups``).
    No pair is lost and none is linked that is less similar; equality of shingles and signatures is that of 64-bit hashes.

    A null text, or one without words, has an empty set, which is linked with nothing: its ``component_id``
    is its own key. A null key counts for no ``component_id``; a group of null keys has null. Rows that
    repeat stay repeated; an empty table gives no rows; other columns are not read. A set has some signatures for every
    ten shingles, so a signature's bucket holds few of all rows unless most texts are both tiny and alike; buckets are
    read as a sorted stream and never held.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    # Tells texts apart also where keys repeat; null keys come last.
    rows = rows.select(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"),
                                F.xxhash64(F.coalesce("text", F.lit(""))).alias("print")).alias("key"), "text")
    sets = described(rows, shingle, signatures=lambda own: signatures(own, part, whole))
    nodes = set_nodes(sets)
    filed = sets.select("id", "signatures").join(nodes.where("size > 0").select("id"), "id")
    met = stored(
        filed.select(F.explode("signatures").alias("key"), "id").repartition("key").sortWithinPartitions("key")
        .mapInArrow(_shared_keys(chunk), "key long, chunk int, id long").select("key", "id"), "shared-keys")
    groups = exact_groups(rows, nodes, met, shingle, Near(part, whole), chunk)
    classes = connected(nodes.where("size > 0"), groups, ["d0", "d1"])
    out = sets.select("key", "d0", "d1", "size").join(classes, ["d0", "d1"], "left").select(
        F.col("key.key").alias(key), F.col("size").alias("n_shingles"),
        F.coalesce(F.col("component_id.key"), F.col("key.key")).alias("component_id"))
    discard(met)
    return out
