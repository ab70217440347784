"""Named queries over the standard tables and their SQL twins."""
