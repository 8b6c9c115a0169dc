"""corpusloom: hybrid document search, evidence gating and corpus preparation on PySpark."""
