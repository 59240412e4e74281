"""Attaching one small state row per key to many rows without a hot-key task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

# A key with more rows than this is hot. At most rows / HOT_ROWS keys can be,
# which bounds what is broadcast below: a trillion rows leave 200,000 keys.
HOT_ROWS = 5_000_000

_STATE = "__state"


def attach_per_key(
    rows: DataFrame,
    state: DataFrame,
    keys: Sequence[str],
    count_col: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join `state` (one row per key, `count_col` rows behind it) to `rows`.

    A join below an aggregate is out of reach of adaptive skew splitting, so hot keys are taken
    out by hand: their state is broadcast and their rows never shuffle; all others meet in an
    ordinary shuffle join. Both branches reuse the one exchange that computes `state`, and
    adaptive execution drops the hot branch, scan included, when there is no hot key.
    Rows with a NULL key keep NULL state.
    """
    keys = list(keys)
    values = [c for c in state.columns if c not in keys and c != count_col]
    packed = state.select(*keys, count_col, F.struct(*values).alias(_STATE))
    hot = F.broadcast(packed.filter(F.col(count_col) > hot_rows).drop(count_col))
    cold = packed.filter(F.col(count_col) <= hot_rows).drop(count_col)

    tagged = rows.join(hot, keys, "left")
    on_hot = tagged.filter(F.col(_STATE).isNotNull())
    others = tagged.filter(F.col(_STATE).isNull()).drop(_STATE)
    nullable = [k for k in keys if rows.schema[k].nullable]
    keyless = reduce(or_, (F.col(k).isNull() for k in nullable), F.lit(False))
    out = others.filter(~keyless).join(cold, keys, "left").unionByName(on_hot)
    if nullable:
        # NULL keys match nothing; kept out of the shuffle, they cannot crowd one task.
        none = F.lit(None).cast(packed.schema[_STATE].dataType)
        out = out.unionByName(rows.filter(keyless).withColumn(_STATE, none))
    return out.select(*rows.columns, *(F.col(_STATE)[v].alias(v) for v in values))
