"""strandline: pangenome analytics on Spark DataFrames."""
