"""Document analytics and retrieval on Apache Spark.

Every public function takes and returns DataFrames (or Column expressions); nothing is executed until the caller acts on the result.
"""
