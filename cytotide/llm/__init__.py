"""Training-data operators: extraction, language ID, dedup, filters, mixing, sharding.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()``
in ``cytotide.llm.queries`` are what the driver contract registers.
"""
