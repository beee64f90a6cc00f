"""Feature engine for keyed, nested tables, expressed as lazy Spark plans.

``sources``    reading, naming and writing of topic tables
``functions``  column rules, feature names, exact order statistics
``operators``  projections, joins, aggregates, windows, encoders, reports
``plans``      multi-step plans: feature definitions, preparation, matrices
"""
