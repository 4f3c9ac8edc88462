"""Column expressions: parsing, cleaning and rendering."""
