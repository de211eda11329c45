from vecloom.operators.diff import diff_rows
from vecloom.operators.join_between import join_between
from vecloom.operators.vertical import vertical_agg

__all__ = ["diff_rows", "join_between", "vertical_agg"]
