"""Training-data operators on Spark: each module is one operator, ``queries`` registers them."""
