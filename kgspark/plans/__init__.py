"""Query plans: predicates, listings, and the registered queries."""
