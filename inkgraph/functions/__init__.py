"""Column functions over page texts."""
