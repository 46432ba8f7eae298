"""Column functions: text normalisation, keys, tokens and small parsers."""
