"""Set-oriented naive Bayes text analytics on Spark DataFrames."""
