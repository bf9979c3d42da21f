"""factloom: product-catalog facts, quality and resolution as Spark DataFrame operators."""
