"""Training-data operators: scoring, archives, classifiers, joins, sharding, search, decontamination, mixing.

Nothing outside this folder imports it.  ``queries.QUERIES`` and ``queries.ORACLE_SQL`` hold what
``__spark_entry__`` registers.
"""
