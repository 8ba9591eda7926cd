"""Document trees: parsing, CSS selection, visible text."""
