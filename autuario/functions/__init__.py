"""Column functions shared by operators and plans."""
