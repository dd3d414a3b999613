"""Event-risk feature engineering, scoring and evaluation on Spark DataFrames."""
