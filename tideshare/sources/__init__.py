"""Reading, writing and checking the tables of the toolkit."""
