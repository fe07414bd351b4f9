"""Training-data operators: extraction, filtering, near-duplicates and tokenisation.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` in
:mod:`palaver.llm.registry` are what ``__spark_entry__`` adds when it is present.
"""
