"""Inventory and sales analytics over ledger tables, on Spark DataFrames.

Layers, bottom up:

* ``sources``   tables, request documents, reports in and out
* ``functions`` Column expressions: text, money, dates, labels, predicates
* ``operators`` DataFrame building blocks: running totals, stock, paging, admission
* ``plans``     business queries, data-quality rules and ledger change jobs
"""
