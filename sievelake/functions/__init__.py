"""Column functions that the predicates and sketches are made of. All of them are native expressions."""
