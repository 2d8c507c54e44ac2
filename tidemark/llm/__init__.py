"""Training-data operators: each module holds one operator and imports nothing outside this subpackage."""
