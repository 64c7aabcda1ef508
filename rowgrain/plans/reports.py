"""A sales report built three ways; only one of them gives right totals.

1. Join order and item rows and stop: the result is finer than the report.
2. Join, then group: the grain is right, the order totals are counted once per item.
3. Group each input to the report's grain, then join: right.
"""

from __future__ import annotations


from rowgrain.frame import GrainedFrame
from rowgrain.operators.aggregates import rows, total

TARGET = ("o_custkey",)


def joined_only(orders: GrainedFrame, items: GrainedFrame) -> GrainedFrame:
    """Refused: its grain is (order, item)."""
    return orders.join(items, [("o_orderkey", "l_orderkey")]).expect_grain(*TARGET)


def joined_then_grouped(orders: GrainedFrame, items: GrainedFrame) -> GrainedFrame:
    """Refused: order totals would be repeated per item."""
    return orders.join(items, [("o_orderkey", "l_orderkey")]).aggregate(
        list(TARGET), total_price=total("o_totalprice"), total_qty=total("l_quantity")
    )


def grouped_then_joined(orders: GrainedFrame, items: GrainedFrame) -> GrainedFrame:
    """Items to their order first, then one-to-one to orders, then to the customer.

    A left join keeps orders without items.
    """
    per_order = items.aggregate("l_orderkey", qty=total("l_quantity", decimal=True))
    with_qty = orders.join(per_order, [("o_orderkey", "l_orderkey")], "left")
    return (
        with_qty.expect_grain("o_orderkey")
        .aggregate(list(TARGET), n_orders=rows(), total_price=total("o_totalprice", decimal=True), total_qty=total("qty", decimal=True))
        .expect_grain(*TARGET)
    )
