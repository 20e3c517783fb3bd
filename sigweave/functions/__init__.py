"""Column functions: every one takes and returns Columns, so Catalyst sees through all of them."""
