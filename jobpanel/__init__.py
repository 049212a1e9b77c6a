"""Job-posting text and panel analytics on Spark DataFrames."""
