"""Part of lexshelf."""
