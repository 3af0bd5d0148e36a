"""Training-data operators: one module per operator, plus the queries over the driver's tables.

Nothing outside this folder imports it. Every operator takes DataFrames and returns DataFrames;
the contracts of the thin ``opN_*`` queries are in :mod:`catalogflow.llm.queries`.
"""
