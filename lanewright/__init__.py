"""lanewright: ordered purchase histories and training-data pipelines on Spark DataFrames."""
