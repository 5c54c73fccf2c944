"""Analytics over annotated count matrices, written as Spark DataFrame plans."""
