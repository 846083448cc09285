"""Training-data operators on Spark: scans, joins, filters, mixing, scoring and token output.

Nothing outside this subpackage imports it; ``queries.py`` lists what it registers.
"""
