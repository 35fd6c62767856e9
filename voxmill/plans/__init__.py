"""Plan rules and the loader."""
