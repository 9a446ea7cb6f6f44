"""Table functions with state per partition, for SQL users.

``register(spark)`` makes ``price_boxes`` known:

    SELECT * FROM price_boxes(TABLE(ticks) PARTITION BY series_id ORDER BY ts, tie, 10.0D, 3)

gives the boxes of a point-and-figure chart, none, one or several for a row. The result has
all columns of the table it is given (those of the row that made the box) and ``box_id``,
``column_id``, ``direction`` and ``level``. A partition is walked in order by one task with
a few numbers of state; ``eventbars.box_columns`` is the form for keys too large for that.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from barline.operators.kernels import box_column

BOX_FIELDS = [
    T.StructField("box_id", T.LongType()), T.StructField("column_id", T.LongType()),
    T.StructField("direction", T.IntegerType()), T.StructField("level", T.DoubleType()),
]


class PriceBoxes:
    """Boxes of the column ``price`` with running numbers."""

    @staticmethod
    def analyze(table: AnalyzeArgument, box: AnalyzeArgument, reversal: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "price" not in table.dataType.names:
            raise Exception("price_boxes needs a table with a column called price")
        for arg, name in ((box, "box"), (reversal, "reversal")):
            if arg.value is None or not float(arg.value) > 0:
                raise Exception(f"{name} must be a positive constant")
        clash = {f.name for f in BOX_FIELDS} & set(table.dataType.names)
        if clash:
            raise Exception(f"columns in use: {sorted(clash)}")
        return AnalyzeResult(T.StructType([*table.dataType.fields, *BOX_FIELDS]))

    def __init__(self):
        self.kernel = None

    def eval(self, row: Row, box: float, reversal: int):
        if self.kernel is None:
            self.kernel = box_column(float(box), int(reversal))
            self.state, self.box_id, self.column_id = self.kernel.init(), -1, -1
        if row["price"] is None:
            return
        self.state, found = self.kernel.step(self.state, float(row["price"]))
        for level, direction, new_column in found:
            self.box_id, self.column_id = self.box_id + 1, self.column_id + new_column
            yield (*row, self.box_id, self.column_id, direction, level)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("price_boxes", udtf(PriceBoxes))
