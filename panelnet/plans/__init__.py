"""Compositions of operators: views of the test tables, the query catalogue, the pipeline."""
