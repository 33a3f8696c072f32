"""From matched content to operations, and what follows from them."""
