"""The engine's functions under SQL names in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.functions.ordinals import ordinal_word
from lectern.operators.synthesis import halves


def register(spark: SparkSession) -> None:
    """``ordinal_word(n, gender)`` and the table function ``split_oversize(text, most)`` for SQL.

    The column functions of ``lectern.functions`` need no registering: they are built-in expressions.
    """
    spark.udf.register("ordinal_word", lambda n, gender: None if n is None else ordinal_word(int(n), gender or "m"), "string")

    @udtf(returnType="idx int, part string")
    class SplitOversize:
        def eval(self, text: str, most: int):
            for i, part in enumerate(halves(text or "", lambda x: len(x) <= most)):
                yield i, part

    spark.udtf.register("split_oversize", SplitOversize)
