"""tidemark: event-study analytics and corpus preparation on Spark DataFrames."""
