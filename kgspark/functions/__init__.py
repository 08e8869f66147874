"""Column functions: identifiers, text and scoring."""
