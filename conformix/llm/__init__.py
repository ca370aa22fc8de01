"""Training-data operators: each is a DataFrame-in, DataFrame-out Spark job."""
