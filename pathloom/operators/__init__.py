"""The algebra: bindings, triples and path operators."""
