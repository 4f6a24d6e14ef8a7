"""Training-data operators: ten independent Spark jobs over document and page tables."""
