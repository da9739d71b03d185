"""Labelled-document jobs on Spark: build, check, train, evaluate, score.

Every public function takes and returns DataFrames (or Columns), so plans from
different modules compose into one Spark job.
"""
