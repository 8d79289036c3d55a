"""lexmill - graded bilingual lexicons as Spark DataFrame operators."""
