"""Column functions shared by sources, operators and reports."""
