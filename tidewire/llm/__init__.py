"""Training-data operators: archives, URL lists, quality, privacy, deduplication, tokens.

Nothing outside this subpackage imports it.  ``tidewire.llm.queries`` registers
one query per operator.
"""
