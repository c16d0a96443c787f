"""Column functions over ``ARRAY<FLOAT>`` vectors."""
