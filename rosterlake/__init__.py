"""Candidate and job matching on Spark, with operators for training-data corpora in rosterlake.llm."""
