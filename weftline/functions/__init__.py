"""Pure building blocks: selectors, types, predicates, method registries and frame utilities."""
