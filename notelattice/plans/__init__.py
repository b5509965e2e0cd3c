"""Note collections derived from the provided tables, and the queries registered over them."""
