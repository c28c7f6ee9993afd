"""Column builders: text, URL and rule expressions on built-in functions."""
