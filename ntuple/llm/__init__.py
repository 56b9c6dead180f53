"""Preparing training text for language models: ten operators, their queries and their SQL.

Nothing outside this folder imports it.  Every operator takes a DataFrame and returns one; the
queries in :mod:`ntuple.llm.queries` apply the operators to whole tables.
"""
