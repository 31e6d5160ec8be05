"""brindle: analytics for retrieval, answer quality and text corpora, expressed as Spark DataFrames."""
