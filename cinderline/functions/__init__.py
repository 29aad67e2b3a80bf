"""Part of cinderline."""
