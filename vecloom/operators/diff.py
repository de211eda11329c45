from pyspark.sql import DataFrame, Window

from vecloom.functions.vertical import diff


def diff_rows(df: DataFrame, columns, order_by, partition_by=()) -> DataFrame:
    """Replace each list column by its difference to the row before, in ``order_by`` within ``partition_by``.

    Rows have no order of their own in Spark, so ``order_by`` is required. An
    empty ``partition_by`` puts every row into one task; give keys at scale.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    order_by = [order_by] if not isinstance(order_by, (list, tuple)) else list(order_by)
    if not order_by:
        raise ValueError("order_by is required")
    w = Window.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by)).orderBy(*order_by)
    return df.withColumns({c: diff(c, window=w) for c in columns})
