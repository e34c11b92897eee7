"""Column functions: text cleaning, tokens, markup, source code, token features."""
