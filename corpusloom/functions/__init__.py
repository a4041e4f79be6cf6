"""Column builders: text, paths, secrets, identifiers, vectors."""
