"""Column functions with exact semantics for text, numbers, instants and identities."""
