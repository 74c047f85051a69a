"""Query definitions, one module per area; importing registers them."""
