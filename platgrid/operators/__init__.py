"""DataFrame operators: parsing to tract rows, and the relational tail on them."""
