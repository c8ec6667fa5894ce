"""Column functions: association scores, comparison operators, text helpers and predicates."""
