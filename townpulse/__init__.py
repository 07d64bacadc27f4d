"""townpulse: public-discussion analytics written as Spark jobs.

Every public function takes and returns DataFrames (or Columns) and stays lazy
unless its docstring says that it runs a job.
"""
