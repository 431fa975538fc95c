"""Column helpers shared by the operators; all of them stay JVM-side."""

from weftline.functions.columns import (
    canonical_pair,
    compact_flags,
    instant_micros,
    jaccard,
    join_null_safe,
    overlap_coefficient,
    relative_change,
    safe_divide,
    sample_ids,
    short_id,
    sorted_set,
    union_arrays,
)

__all__ = [
    "canonical_pair", "compact_flags", "instant_micros", "jaccard", "join_null_safe", "overlap_coefficient", "relative_change",
    "safe_divide", "sample_ids", "short_id", "sorted_set", "union_arrays",
]
