"""Training-data operators: secrets, quality, toxicity, extraction, language, joins, search, tokens.

Nothing outside this subpackage imports it.
"""
