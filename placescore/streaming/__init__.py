"""No streaming operator of its own.

Column functions and the grouped counts of ``operators.tables`` keep no state of their own, so they apply
to a streaming DataFrame unchanged: ``count_by(with_cell(stream), "cell")`` is a running count per cell.
"""
