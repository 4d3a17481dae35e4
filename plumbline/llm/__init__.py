"""Training-data operators. Nothing outside this subpackage imports it, and it can be deleted whole."""
