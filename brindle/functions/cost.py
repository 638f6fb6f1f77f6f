"""Cost formulas of plans and indexes, for explanations; Catalyst chooses the physical plan by its own."""

from __future__ import annotations

import math

BUCKETS = 100
MOST = 2**63 - 1


def search_cost(kind: str, blocks: int, per_block: int) -> int:
    """Blocks read for one probe."""
    if kind == "hash":
        return blocks // BUCKETS
    if kind == "btree":
        return 1 if blocks <= 0 or per_block <= 1 else 1 + round(math.log(blocks) / math.log(per_block))
    return -1


def product_blocks(b1: int, r1: int, b2: int) -> int:
    return b1 + r1 * b2


def index_join_blocks(b1: int, r1: int, index_blocks: int, records: int) -> int:
    return b1 + r1 * index_blocks + records


def term_reduction(left_distinct: int | None, right_distinct: int | None, equal_constants: bool | None) -> int:
    """Selectivity divisor of an equality: of two fields the larger count, of a field and a constant the field's."""
    if left_distinct is not None and right_distinct is not None:
        return max(left_distinct, right_distinct)
    if left_distinct is not None or right_distinct is not None:
        return left_distinct if left_distinct is not None else right_distinct
    return 1 if equal_constants else MOST
