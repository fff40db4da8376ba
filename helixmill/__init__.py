"""helixmill: sequence classification on Spark DataFrames, plus training-data operators."""
