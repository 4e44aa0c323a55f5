"""Episode panels, transitions and treatment-effect estimates as Spark jobs.

Every operator takes and returns DataFrames.  Nothing is executed until the
caller acts on the result, except where a docstring says that an operator
first counts keys or fits a model.
"""
