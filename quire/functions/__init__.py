"""Column helpers shared by the table operators."""
