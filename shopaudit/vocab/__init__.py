"""Word lists, signatures and code tables the operators take as arguments."""
